"""Plain statements of the rules, to test against on small inputs."""

from __future__ import annotations


def iou(a, b):
    w = max(0.0, min(a["xmax"], b["xmax"]) - max(a["xmin"], b["xmin"]))
    h = max(0.0, min(a["ymax"], b["ymax"]) - max(a["ymin"], b["ymin"]))
    if w * h == 0:
        return 0.0
    area = lambda x: (x["xmax"] - x["xmin"]) * (x["ymax"] - x["ymin"])
    return w * h / (area(a) + area(b) - w * h)


def match(left, right, threshold=0.5):
    """(left item_ix, right item_ix, iou) in the order of ``left``."""
    used, found = set(), []
    order = lambda box: box["item_ix"]
    right = sorted(right, key=order)
    for a in sorted(left, key=order):
        rated = [(iou(a, b), -n) for n, b in enumerate(right) if n not in used and b["label"] == a["label"]]
        if rated and max(rated)[0] >= threshold:
            value, n = max(rated)
            used.add(-n)
            found.append((a["item_ix"], right[-n]["item_ix"], value))
    return found


def score(left, right, threshold=0.5):
    if not left and not right:
        return 1.0
    if not left or not right:
        return 0.0
    return sum(v for *_, v in match(left, right, threshold)) / max(len(left), len(right))
