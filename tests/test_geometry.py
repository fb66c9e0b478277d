"""Page geometry against plain Python on random and on large pages."""

import random
import re
from collections import defaultdict

import pytest

from examlake.operators import geometry, rounds

RUN = "page long, seq long, text string, x double, x1 double, y double, yt double, size double"
BAR = "page long, rule long, x double, w double, y double"
BOX = "page long, id long, x0 double, x1 double, y0 double, y1 double"


def some_page(rng, page):
    runs, bars, seq = [], [], 0
    for line in range(rng.randint(1, 9)):
        for column in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 3)):
                x = 40.0 + column * 120 + rng.randint(0, 40)
                y = 700.0 - line * rng.choice([12, 16, 30]) - rng.choice([0, 0, 4, 9])
                tall = rng.random() < 0.05
                runs.append((page, seq, rng.choice(["word", "√", "A. x", "B、", " ∛ ", "a"]), x, x + rng.randint(4, 60), y, y + (30 if tall else 9), rng.choice([10.5, 10.5, 7.0, 0.0])))
                seq += 1
    for k in range(rng.randint(0, 8)):
        _, _, _, x, x1, y, *_ = rng.choice(runs)
        bars.append((page, k, x + rng.choice([-2, 0, x1 - x + 3]), float(rng.randint(5, 70)), y + rng.choice([-6, -3, 6, 12])))
    return runs, bars


def body(runs):
    sizes = [r[7] for r in runs if r[7]]
    return max(sizes, key=sizes.count) if sizes else 10.5


def read(runs, bars):
    """Sequence numbers of a page's runs in the order that they are read."""
    bs = body(runs)
    lines = []
    for r in sorted(runs, key=lambda r: (-r[5], r[3], r[1])):
        if lines and lines[-1][-1][5] - r[5] <= bs * 0.9 and lines[-1][0][5] - r[5] <= bs * 1.15:
            lines[-1].append(r)
        else:
            lines.append([r])

    def on(r, b):
        return (min(r[4], b[2] + b[3]) - max(r[3], b[2])) / max(1e-6, r[4] - r[3]) >= 0.6

    def glued(a, b):
        low, high = min(r[5] for r in a), max(r[5] for r in b)
        if low - high > bs * 2.6:
            return False
        if any(r[6] - r[5] > bs * 1.4 and r[6] >= low - 1 and r[5] <= high + 1 for r in a + b):
            return True
        for bar in bars:
            if high - 1 <= bar[4] <= low + 1 and any(on(r, bar) for r in b):
                if any(on(r, bar) or (r[2].strip() in "√∛∜" and -2 <= bar[2] - r[4] <= 8) for r in a):
                    return True
        return False

    k = 0
    while k < len(lines) - 1:
        if glued(lines[k], lines[k + 1]):
            lines[k : k + 2] = [lines[k] + lines[k + 1]]
            k = 0
        else:
            k += 1

    def columns(line):
        out = []
        for r in sorted(line, key=lambda r: r[3]):
            if out and r[3] - out[-1][-1][4] <= bs * 2.5:
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def down(column):
        groups = []
        for r in sorted(column, key=lambda r: -r[5]):
            if groups and abs(groups[-1][0][5] - r[5]) <= bs * 0.9:
                groups[-1].append(r)
            else:
                groups.append([r])
        return [r for g in groups for r in sorted(g, key=lambda r: r[3])]

    parts, k = [], 0
    while k < len(lines):
        line, wrapped = lines[k], False
        while k + 1 < len(lines):
            nxt, cols = lines[k + 1], columns(line)
            bands = [(min(r[3] for r in c) - bs, max(r[4] for r in c) + bs) for c in cols]
            gap = min(r[5] for r in line) - max(r[5] for r in nxt)
            inside = all(any(a <= r[3] and r[4] <= b for a, b in bands) for r in nxt)
            if len(cols) < 2 or not inside or any(re.match(r"[ABCD]\s*[.．、]", r[2].lstrip()) for r in nxt) or not 0 < gap <= bs * 1.8 or len(nxt) >= len(line):
                break
            for r in nxt:
                next(c for c, (a, b) in zip(cols, bands, strict=True) if a <= r[3] <= b).append(r)
            line, wrapped, k = [r for c in cols for r in down(c)], True, k + 1
        parts.append((line, wrapped))
        k += 1
    parts.sort(key=lambda p: -max(r[5] for r in p[0]))
    return [r[1] for line, wrapped in parts for r in ([r for c in columns(line) for r in down(c)] if wrapped else sorted(line, key=lambda r: r[3]))]


def test_reading_order_on_random_pages(spark):
    rng = random.Random(11)
    pages = {p: some_page(rng, p) for p in range(160)}
    runs, bars = [r for p in pages.values() for r in p[0]], [b for p in pages.values() for b in p[1]]
    lost = [(None, 1, "x", 1.0, 2.0, 3.0, 4.0, 5.0), (3, 999, "x", None, None, None, None, None)]
    got = defaultdict(list)
    for r in geometry.reading_order(spark.createDataFrame(runs + lost, RUN).repartition(5), spark.createDataFrame(bars, BAR), "page").orderBy("page", "order").collect():
        got[r.page].append(r.seq)
    assert {p: read(*x) for p, x in pages.items()} == got
    assert geometry.reading_order(spark.createDataFrame([], RUN), spark.createDataFrame([], BAR), "page").count() == 0


def test_a_fraction_a_radical_and_a_wrapped_column_are_read_as_one(spark):
    runs = [
        (1, 0, "v =", 40.0, 60.0, 700.0, 708.0, 10.5), (1, 1, "a", 70.0, 90.0, 706.0, 714.0, 10.5), (1, 2, "b", 72.0, 88.0, 690.0, 698.0, 10.5),
        (2, 0, "√", 40.0, 50.0, 700.0, 708.0, 10.5), (2, 1, "r/g", 52.0, 70.0, 686.0, 694.0, 10.5), (2, 2, "end", 90.0, 110.0, 700.0, 708.0, 10.5),
        (3, 0, "A. long", 40.0, 90.0, 700.0, 708.0, 10.5), (3, 1, "B. short", 200.0, 260.0, 700.0, 708.0, 10.5), (3, 2, "rest", 42.0, 70.0, 686.0, 694.0, 10.5),
        (4, 0, "A. one", 40.0, 90.0, 700.0, 708.0, 10.5), (4, 1, "B. two", 200.0, 260.0, 700.0, 708.0, 10.5), (4, 2, "C. three", 42.0, 90.0, 686.0, 694.0, 10.5),
    ]
    bars = [(1, 0, 68.0, 24.0, 698.0), (2, 0, 51.0, 20.0, 697.0)]
    got = geometry.reading_order(spark.createDataFrame(runs, RUN), spark.createDataFrame(bars, BAR), "page").orderBy("page", "order").collect()
    assert {p: [r.seq for r in got if r.page == p] for p in range(1, 5)} == {1: [0, 1, 2], 2: [0, 1, 2], 3: [0, 2, 1], 4: [0, 1, 2]}
    assert len({r.line for r in got if r.page == 1}) == len({r.line for r in got if r.page == 3}) == 1 and len({r.line for r in got if r.page == 4}) == 2


def tables_of(boxes):
    upright = sorted([(round((b[2] + b[3]) / 2, 2), round(b[4], 2), round(b[5], 2), b[1]) for b in boxes if not (b[5] - b[4] <= 2.5 and b[3] - b[2] >= 4) and b[3] - b[2] <= 2.5 and b[5] - b[4] >= 8], key=lambda v: (-v[2], v[3]))
    groups = []
    for v in upright:
        if groups and any(min(v[2], u[2]) - max(v[1], u[1]) > 4 for u in groups[-1]):
            groups[-1].append(v)
        else:
            groups.append([v])
    out = []
    for g in groups:
        if len(g) >= 3:
            x0, x1, y0, y1 = min(v[0] for v in g), max(v[0] for v in g), min(v[1] for v in g), max(v[2] for v in g)
            flat = [(b[2], b[3]) for b in boxes if b[5] - b[4] <= 2.5 and b[3] - b[2] >= 4 and y0 - 3 <= (b[4] + b[5]) / 2 <= y1 + 3 and b[3] > x0 - 3 and b[2] < x1 + 3]
            out.append([min([x0, *[f[0] for f in flat]]) - 2, y0 - 2, max([x1, *[f[1] for f in flat]]) + 2, y1 + 2])
    out.sort(key=lambda t: -t[3])
    k = 0
    while k < len(out) - 1:
        a, b = out[k], out[k + 1]
        if min(a[2], b[2]) - max(a[0], b[0]) > 0.8 * min(a[2] - a[0], b[2] - b[0]) and a[1] - b[3] < 6:
            out[k : k + 2] = [[min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), a[3]]]
            k = 0
        else:
            k += 1
    return out


def test_tables_on_random_pages(spark):
    rng = random.Random(5)
    boxes, n = [], 0
    for page in range(120):
        for _ in range(rng.randint(0, 40)):
            x, y = float(rng.randint(0, 8) * 20), float(rng.randint(0, 30) * 8)
            size = rng.choice([(0.5, rng.choice([6, 8, 9, 14, 30])), (1.0, 12), (rng.choice([3, 4, 60]), 0.5), (2.0, 2.0)])
            boxes.append((page, n, x, x + size[0], y, y + size[1]))
            n += 1
    got = defaultdict(list)
    for r in geometry.find_tables(spark.createDataFrame([*boxes, (None, 1, 0.0, 0.0, 0.0, 20.0)], BOX).repartition(5), "page").orderBy("page", "tid").collect():
        got[r.page].append([r.x0, r.y0, r.x1, r.y1])
    want = {p: tables_of([b for b in boxes if b[0] == p]) for p in range(120)}
    assert {p: [pytest.approx(t) for t in w] for p, w in want.items() if w} == got
    assert geometry.find_tables(spark.createDataFrame([], BOX), "page").count() == 0


def test_a_page_of_ten_thousand_atoms_in_one_chain_of_rules(spark):
    """Each rule lies over the atom before it and the one after, so all are one region; a lone atom beyond is in none."""
    n = 10000
    atoms = [(1, i, "a", i * 20.0, i * 20.0 + 10, 100.0, 108.0, 10.5) for i in range(n)] + [(1, n, "z", 10.0, 20.0, 900.0, 908.0, 10.5), (1, n + 1, "2", (n - 1) * 20.0 + 11, (n - 1) * 20.0 + 15, 104.0, 109.0, 6.0), (1, n + 2, "3", (n - 1) * 20.0 + 17, (n - 1) * 20.0 + 21, 104.0, 109.0, 6.0)]
    rules = [(1, i, i * 20.0, 30.0, 95.0) for i in range(n - 1)]
    got = geometry.formula_regions(spark.createDataFrame(atoms, RUN), spark.createDataFrame(rules, BAR), "page").collect()
    assert {r.region for r in got} == {0} and {r.atom: r.grown for r in got} == {**dict.fromkeys(range(n), 0), n + 1: 1, n + 2: 2}


def test_components_against_plain_python(spark):
    rng = random.Random(3)
    edges = [(p, rng.randint(0, 60), rng.randint(0, 60)) for p in range(4) for _ in range(45)]
    want = {}
    for p in range(4):
        label = {a: a for q, a, _ in edges if q == p}
        moved = True
        while moved:
            moved = False
            for b in {b for q, _, b in edges if q == p}:
                own = [a for q, a, c in edges if q == p and c == b]
                low = min(label[a] for a in own)
                moved |= any(label[a] != low for a in own)
                label.update(dict.fromkeys(own, low))
        want.update({(p, a): c for a, c in label.items()})
    got = rounds.components(spark.createDataFrame(edges * 2, "p int, a int, b int"), "p", "a", "b").collect()
    assert {(r.p, r.a): r.comp for r in got} == want and len(got) == len(want)


def test_runs_stop_at_other_lines_and_follow_their_own_direction(spark):
    chars = [
        (1, 0, "n", 10.0, 15.0, 100.0, 107.0, 10.5, 0), (1, 1, "m", 15.1, 20.0, 100.0, 107.0, 10.5, 0), (1, 2, "2", 20.5, 23.0, 104.0, 108.0, 6.0, 0), (1, 3, "R", 23.5, 28.0, 100.0, 107.0, 10.5, 0), (1, 4, "H", 28.1, 33.0, 100.0, 107.0, 10.5, 0), (1, 5, " ", 33.0, 36.0, 100.0, 107.0, 10.5, 0),
        (2, 0, "u", 50.0, 57.0, 10.0, 15.0, 10.5, 90), (2, 1, "p", 50.0, 57.0, 15.1, 20.0, 10.5, 90), (2, 2, "x", 50.0, 55.0, 20.2, 27.0, 10.5, 0), (2, 3, "d", 90.0, 97.0, 30.0, 35.0, 10.5, 270), (2, 4, "o", 90.0, 97.0, 24.9, 29.9, 10.5, 270),
        (2, 5, "b", 70.0, 75.0, 60.0, 67.0, 10.5, 180), (2, 6, "c", 64.9, 69.9, 60.0, 67.0, 10.5, 180), (None, 1, "x", 0.0, 1.0, 0.0, 1.0, 1.0, 0),
    ]
    got = geometry.text_runs(spark.createDataFrame(chars, "page long, seq long, text string, x double, x1 double, y double, yt double, size double, angle int"), "page").collect()
    assert sorted((r.page, r.angle, r.text) for r in got) == [(1, 0, "2"), (1, 0, "RH"), (1, 0, "nm"), (2, 0, "x"), (2, 90, "up"), (2, 180, "bc"), (2, 270, "do")]


def test_labels_against_plain_python(spark):
    rng = random.Random(6)
    parts = [(s, p, float(p * 10), float(p * 9), float(p * 10 + 12), float(p * 9 + 6)) for s in range(30) for p in range(5)]
    labels = [(s, i, i, rng.choice(["v", "force", "磁场", ""]), rng.choice([0, 1, 2, 3, 4, 99]), rng.choice(["above", "below", "left", "right", "center", None, "odd"]), rng.choice(["start", "middle", "end", None]), *((5.0, 6.0) if rng.random() < 0.2 else (None, None))) for s in range(30) for i in range(25)]
    want = {}
    for s in range(30):
        placed = []
        for _, i, _, text, of, side, anchor, px, py in [x for x in labels if x[0] == s]:
            box = next((p[2:] for p in parts if p[:2] == (s, of)), None)
            if px is None and box is None:
                want[s, i] = (None, None, "lost")
                continue
            if px is None:
                x0, y0, x1, y1 = box
                mx, my = (x0 + x1) / 2, (y0 + y1) / 2
                px, py = {"above": (mx, y0 - 6), "below": (mx, y1 + 14.9), "left": (x0 - 6, my + 4), "right": (x1 + 6, my + 4), "center": (mx, my + 4)}.get(side or "above", (mx, my))
            w = sum(13.1 if ord(c) > 0x2E7F else 6.0 for c in text)
            left = px - {"middle": w / 2, "end": w}.get(anchor or "middle", 0)
            tries = 0
            while tries < 12 and any(not (left + w <= a or left >= b or py - 14.9 * 0.78 + 14.9 <= t or t + 14.9 <= py - 14.9 * 0.78) for t, a, b in placed):
                tries, py = tries + 1, py + (-4 if side == "above" else 4)
            placed.append((py - 14.9 * 0.78, left, left + w))
            want[s, i] = (px, py, "crowded" if tries == 12 else "placed")
    got = geometry.settle_labels(spark.createDataFrame(labels, "scene long, id long, seq long, text string, of long, side string, anchor string, px double, py double"), spark.createDataFrame(parts, "scene long, id long, x0 double, y0 double, x1 double, y1 double"), "scene").collect()
    assert {(r.scene, r.id): (r.x, r.y, r.outcome) for r in got} == want and {r.outcome for r in got} == {"placed", "crowded", "lost"}
