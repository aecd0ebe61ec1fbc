"""A plain-Python statement of the folds, for comparison: positions by loops over lists."""


def series_folds(n, mode="oos", k=5, size=None, gap=0, m=None, anchors=None):
    """[(train positions, test positions)] of a series of n rows; anchors are positions."""
    if anchors is None:
        size = size or n // (k + 1)
        starts = [n - (k - i) * size for i in range(k)] if mode == "oos" else [max(0, n - size)]
    else:
        starts, size = sorted(anchors), size or 1
    folds = []
    if mode == "oos":
        for s in starts:
            test = [p for p in range(n) if s <= p < s + size]
            end = s - gap
            train = [p for p in range(n) if p < end and (not m or p >= end - m)]
            folds.append((train, test))
        return folds
    test = list(starts) if anchors is not None and len(anchors) > 1 else [p for p in range(n) if starts[0] <= p < starts[0] + size]
    end = max(test) + 1
    train = [p for p in range(end) if m is None or p >= end - max(m, len(test))]
    return [(train, test)]


def panel_folds(times, mode="oos", k=5, size=None, gap=0, m=None, anchors=None):
    """[{entity: (train positions, test positions)}]; times: {entity: sorted times}; anchors: times. Entities without a test row are left out."""
    size = size or 1
    every = sorted({t for own in times.values() for t in own})
    if anchors is None:
        anchors = [every[len(every) - (k - i) * size] for i in range(k)] if mode == "oos" else [every[-1]]
    folds = []
    for group in ([a] for a in anchors) if mode == "oos" else [anchors]:
        fold = {}
        for e, own in times.items():
            at = [own.index(t) for t in group if t in own]
            if not at:
                continue
            test = sorted(set(at)) if len(group) > 1 else [p for p in range(len(own)) if at[0] <= p < at[0] + size]
            if mode == "oos":
                end = at[0] - gap
                train = [p for p in range(len(own)) if p < end and (not m or p >= end - m)]
            else:
                end = max(test) + 1
                train = [p for p in range(end) if m is None or p >= end - max(m, len(test))]
            fold[e] = (train, test)
        folds.append(fold)
    return folds
