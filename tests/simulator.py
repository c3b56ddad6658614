"""Event-at-a-time replay used only as a test oracle for the set-based operators."""

from collections import Counter, defaultdict, deque

import numpy as np


def simulate(
    events,
    window,
    slide,
    budget=None,
    adaptive=None,
    guard=None,
    accounting=None,
):
    """events: list of (time, device, sensor, value) in arrival order.

    budget: fixed seconds; adaptive: dict with the LatenessConfig fields;
    guard: (policy, seconds, cycle); accounting: (cycle, horizon, scan_every).
    """
    hot, archive, frozen = {}, {}, {}
    top = first = wm = None
    history = deque(maxlen=adaptive["history"]) if adaptive else None
    current = adaptive["initial"] if adaptive else budget
    worst = overflow = 0
    out = {
        "budget": [], "watermark": [], "lateness": [], "cycles": [], "accounting": [],
        "sizes": [], "opened": {}, "archived": {}, "released": {}, "pairs": Counter(),
        "peak_hot": 0, "over": 0,
    }
    last_off, rounds = 0, 0

    def cycle(pos, seen):
        g = guard[1] if guard[0] == "fixed" else max(
            1, current, worst + 1, overflow + current
        )
        gone = [k for k in archive if k[0] + window + g <= wm]
        for k in gone:
            frozen[k] = archive.pop(k)
            out["released"][k] = pos
        out["cycles"].append((pos, seen, g, len(gone)))

    def account(pos, seen, force=False):
        nonlocal last_off, rounds
        if force or rounds % accounting[2] == 0:
            last_off = sum(k[0] + window + accounting[1] <= wm for k in archive)
        rounds += 1
        out["accounting"].append((pos, seen, len(hot), len(archive), last_off))

    for n, (t, dev, sen, val) in enumerate(events, 1):
        late = 0 if top is None else max(0, top - t)
        first = t if first is None else first
        top = t if top is None else max(top, t)
        if adaptive:
            history.append(late)
            if n >= adaptive["min_observations"] and (
                n == adaptive["min_observations"] or n % adaptive["interval"] == 0
            ):
                a = sorted(history)
                p = float(np.percentile(a, int(adaptive["percentile"] * 100)))
                ooo = sum(x > 0 for x in history) / len(history)
                big = adaptive["maximum"]
                span = top - first
                rate = 0.0 if n <= 1 else (n / span if span > 0 else float(n))
                raw = (
                    p + ooo * 0.2 * big + min(0.1 * big, 0.1 * (top - t))
                    + min(0.1 * big, rate / 1000)
                )
                current = max(adaptive["minimum"], min(big, round(round(raw, 9))))
        if current is not None:
            wm = top - current if wm is None else max(wm, top - current)
        if current is not None and late > current:
            out["over"] += 1
        base = t // slide * slide
        for start in range(base - window + slide, base + slide, slide):
            k = (start, dev, sen)
            if k in frozen:
                out["pairs"]["C"] += 1
            elif k in archive:
                archive[k].append(val)
                out["pairs"]["B"] += 1
            else:
                if k not in hot:
                    hot[k] = []
                    out["opened"][k] = n
                hot[k].append(val)
                out["pairs"]["A"] += 1
        out["peak_hot"] = max(out["peak_hot"], len(hot))
        if wm is not None:
            for k in [k for k in hot if k[0] + window <= wm]:
                archive[k] = hot.pop(k)
                out["archived"][k] = n
        worst = max(worst, late)
        if current and late > current:
            overflow = max(overflow, late - current)
        if accounting and n % accounting[0] == 0:
            account(n, n)
        if guard and n % guard[2] == 0:
            cycle(n, n)
        out["budget"].append(current)
        out["watermark"].append(wm)
        out["lateness"].append(late)
        out["sizes"].append((len(hot), len(archive), len(frozen)))
    n = len(events)
    if accounting:
        account(n + 1, n, True)
    if guard:
        cycle(n + 1, n)
    rows = defaultdict(list)
    for tier in (frozen, archive, hot):
        for k, vals in tier.items():
            rows[k] = vals
    out["rows"] = {k: (len(v), sum(v), min(v), max(v)) for k, v in rows.items()}
    out["final"] = (len(hot), len(archive), len(frozen))
    return out
