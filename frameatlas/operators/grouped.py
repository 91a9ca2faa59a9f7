"""Order-dependent rules that run per small group, and iterative numerics.

Each function is the body of an ``applyInPandas`` over one key (a picture's
detections, a segment's vectors).  Input order is fixed by an explicit sort, so
results don't depend on partitioning.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameatlas.runtime import materialize, partitions_for


_DTYPES = {"long": "Int64", "int": "Int64", "double": "float64", "string": "object", "boolean": "object"}


def per_small_group(df: DataFrame, key: str, fn: Callable[[list[dict]], list[dict]], schema: str, rows_per_batch: int = 20_000) -> DataFrame:
    """``fn`` on the records of every group of ``key``, many groups to one Python call.

    A call per picture costs more than the rule itself, so keys are hashed into batches
    whose number follows the rows; a batch holds whole groups.
    """
    written = materialize(df, "groups")  # counted from the footers: what makes the rows runs once
    df, n = written.df, partitions_for(written.rows(), rows_per_batch)
    fields = [f.strip().split()[0] for f in schema.split(",")]
    kinds = {f.strip().split()[0]: f.strip().split()[1] for f in schema.split(",")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = pdf.drop(columns="_batch").sort_values(key, kind="stable").to_dict("records")
        out = [r for _, g in itertools.groupby(records, key=lambda r: r[key]) for r in fn(list(g))]
        # typed by the schema: without a record pandas would take text for numbers, which Arrow refuses
        return pd.DataFrame({f: pd.Series([r[f] for r in out], dtype=_DTYPES[kinds[f]]) for f in fields})

    return df.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("_batch").applyInPandas(run, schema)


# ---------------------------------------------------------------- boxes of one picture
def _by_id(r: dict):
    return r["detection_id"], -1 if pd.isna(r["obj_no"]) else r["obj_no"]


def _box(r: dict) -> tuple[float, float, float, float]:
    return r["left"], r["top"], r["right"], r["bottom"]


def iou(a, b) -> float:
    """Boxes are (left, top, right, bottom)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    o = max(0.0, w) * max(0.0, h)
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    u = area(a) + area(b) - o
    return o / u if u > 0 else 0.0


# fixed values: (rule, preferred class, classes it stands before); pairs first, then families
SUPPRESSION = [
    ("pair_63_133", 133, {63}),
    ("pair_67_137", 137, {67}),
    ("pair_73_123", 123, {73}),
    ("pair_65_135", 135, {65}),
    ("pair_66_136", 136, {66}),
    ("family_124_tablet", 124, {63, 67, 73, 133, 137, 123}),
    ("family_93_clipboard", 93, {63, 67, 73, 133, 137}),
    ("family_127_calculator", 127, {67, 137}),
]
BONUS, SURE, UNSURE, MODERATE = 0.2, 0.9, 0.3, 0.6
_BEFORE = {(best, other) for _, best, others in SUPPRESSION for other in others}


def _worth(a: dict, b: dict) -> float:
    """Confidence of a box against another one: a class that stands before the other's counts more."""
    return a["conf"] + BONUS * ((a["class_id"], b["class_id"]) in _BEFORE)


def resolve_overlaps(rows: list[dict], at: float = 0.5) -> list[dict]:
    """Boxes of a picture without double detections.

    Boxes are taken by detection id, each against all later ones left; the last pair
    that a box is in decides.  Of two that
    overlap by ``at`` the one worth more goes on (ties: the earlier) if one is sure
    (0.9), moderately sure (0.6), of the same class, or their difference is clear for
    that overlap (0.3, less the more they overlap).  Of other pairs both stay.  Boxes
    of a class that overlap by one and a half times ``at`` also become their union.
    """
    rows = sorted(rows, key=_by_id)
    gone, kept = set(), []
    for i, first in enumerate(rows):
        if i in gone:
            continue
        best = first
        for j in range(i + 1, len(rows)):
            other = rows[j]
            o = 0.0 if j in gone else iou(_box(first), _box(other))
            if o < at:
                continue
            a, b = _worth(first, other), _worth(other, first)
            surest, same = max(first["conf"], other["conf"]), first["class_id"] == other["class_id"]
            clear = surest >= SURE or abs(a - b) >= UNSURE * (1 - o)
            if not (clear or same or surest >= MODERATE):
                continue
            if clear or not same or o < 1.5 * at:
                best = first if a >= b else other
            if same and o >= 1.5 * at:
                p, q = _box(first), _box(other)
                union = dict(zip(("left", "top", "right", "bottom"), (*map(min, p[:2], q[:2]), *map(max, p[2:], q[2:]))))
                best, first = best | union, first | union if best is first else first
            gone.add(j)
        kept.append(best)
    return kept


def suppress(rows: list[dict], at: float = 0.7) -> tuple[list[dict], list[dict]]:
    """Boxes left by the suppression rules, and one event per pair that a rule looked at.

    Rules go in order; of two boxes that overlap by ``at`` the one worth less is taken
    away, at a tie the one that isn't preferred.  An event is ``rule, decision`` (keep
    or suppress), ``winner, loser`` (null where both stay), and whether the bonus or
    the tie rule decided.
    """
    rows = sorted(rows, key=_by_id)
    alive, events = [True] * len(rows), []
    for rule, best, others in SUPPRESSION:
        ours, theirs = [i for i, r in enumerate(rows) if alive[i] and r["class_id"] == best], [i for i, r in enumerate(rows) if alive[i] and r["class_id"] in others]
        for i, j in [(i, j) for j in theirs for i in ours] if rule.startswith("pair") else [(i, j) for i in ours for j in theirs]:
            if not (alive[i] and alive[j]):
                continue
            event = {"image_id": rows[i]["image_id"], "rule": rule, "decision": "keep", "winner": None, "loser": None, "by_bonus": False, "by_tie": False}
            if iou(_box(rows[i]), _box(rows[j])) >= at:
                a, b = _worth(rows[i], rows[j]), _worth(rows[j], rows[i])
                win, lose = (i, j) if a >= b else (j, i)
                alive[lose] = False
                event |= {"decision": "suppress", "winner": rows[win]["detection_id"], "loser": rows[lose]["detection_id"], "by_bonus": win == i, "by_tie": a == b}
            events.append(event)
    return [r for r, ok in zip(rows, alive) if ok], events


def merge_adjacent(rows: list[dict], gap: float = 20.0, at: float = 0.5) -> list[dict]:
    """Boxes of a class that touch (within ``gap`` on one axis, overlapping on the other) or overlap become one.

    Components of the touching relation are merged whole; confidence is the best one's.
    """
    rows = sorted(rows, key=_by_id)
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, p in enumerate(rows):
        for j in range(i + 1, len(rows)):
            q = rows[j]
            if p["class_id"] != q["class_id"]:
                continue
            a, b = _box(p), _box(q)
            gx, gy = max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3])
            if (gx <= gap and gy < 0) or (gy <= gap and gx < 0) or iou(a, b) > at:
                root[find(j)] = find(i)
    groups: dict[int, list[dict]] = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    low, high = lambda g, c: min(r[c] for r in g), lambda g, c: max(r[c] for r in g)
    return [g[0] | {"conf": high(g, "conf"), "left": low(g, "left"), "top": low(g, "top"), "right": high(g, "right"), "bottom": high(g, "bottom"), "n_merged": len(g)} for g in groups.values()]


NEW_CLASS_PRIORITY = {132: 700, 133: 650, 137: 600, 123: 500, 127: 450, 136: 400, 93: 350, 135: 100}  # fixed values: larger numbers win, other classes have 0


def refine_new(rows: list[dict], at: float = 0.5) -> list[dict]:
    """Of the new boxes of a picture that overlap each other, directly or over others, one stays.

    Components of the relation 'overlap of at least ``at``' are taken over all classes; the winner has the highest
    class priority, ties go to the earlier row, then to the lower class.  ``n_members`` is the size of its component.
    """
    rows = sorted(rows, key=lambda r: (*_by_id(r), r["class_id"], _box(r)))
    out, seen = [], set()
    for start in range(len(rows)):
        if start in seen:
            continue
        seen.add(start)
        group = [start]
        for i in group:
            near = [j for j in range(len(rows)) if j not in seen and iou(_box(rows[i]), _box(rows[j])) >= at]
            seen.update(near)
            group += near
        win = min(group, key=lambda i: (-NEW_CLASS_PRIORITY.get(rows[i]["class_id"], 0), i))
        out.append(rows[win] | {"n_members": len(group)})
    return out


# ---------------------------------------------------------------- nine slots
SLOT_ZONES = ("top_face", "left_eye", "right_eye", "mouth", "shoulder", "waist", "feet")
TOUCH_NEAR, TOUCH_FAR, DUAL_RATIO, TIE_CLASS = 0.5, 1.0, 2.5, 27


# fixed values: what a slot's level (unusual 1, usual 2) adds to confidence; 0 is never
LEVEL_BIAS = {1: -0.12, 2: 0.06}


def assign_slots(rows: list[dict], levels: dict[tuple[int, str], int] | None = None) -> list[dict]:
    """One record per picture with a detection id (or null) for each of nine slots.

    Rows carry ``in_<slot>`` (does the box lie in the slot's zone) and ``in_tie``.
    ``levels`` are the levels of (class, slot), "hand" standing for both hands; a class
    that isn't listed may stand anywhere, level 0 nowhere, and the others move the score.

    Order: neck ties first (shoulder zone, then the hands), then the best object of each
    hand (touching within 0.5 face heights, else within 1.0; nearer, surer objects first;
    an object nearer to one hand by a factor of 2.5 goes to that hand alone), then eyes,
    then the remaining zones by confidence.  An object that both hands hold may stand in
    both hand slots; every other object is used once.
    """
    first = rows[0]
    rows = sorted((r for r in rows if pd.notna(r["left"])), key=lambda r: (-r["conf"], r["detection_id"]))
    hands = {"left_hand": (first["left_pointer_x"], first["left_pointer_y"]), "right_hand": (first["right_pointer_x"], first["right_pointer_y"])}
    hands = {k: v for k, v in hands.items() if all(pd.notna(x) for x in v) and tuple(v) != (0.0, 8.0)}  # (0, 8) stands for an absent hand
    out: dict[str, int | None] = {s: None for s in ("left_hand", "right_hand", *SLOT_ZONES)}
    used: set[int] = set()

    def gap(r, p):
        dx, dy = max(r["left"] - p[0], 0.0, p[0] - r["right"]), max(r["top"] - p[1], 0.0, p[1] - r["bottom"])
        return float(np.hypot(dx, dy))

    def worth(r, slot):
        level = 2 if levels is None else levels.get((r["class_id"], "hand" if slot.endswith("_hand") else slot), 2)
        return None if level == 0 else r["conf"] + (0.0 if levels is None else LEVEL_BIAS[level])

    def put(slot, r):
        out[slot] = int(r["detection_id"])
        used.add(int(r["detection_id"]))

    for r in [r for r in rows if r["class_id"] == TIE_CLASS]:
        if out["shoulder"] is None and r["in_tie"]:
            put("shoulder", r)
        else:
            near = [h for h, p in hands.items() if out[h] is None and gap(r, p) <= TOUCH_NEAR]
            for h in near:
                put(h, r)
    for h, p in hands.items():
        if out[h] is not None:
            continue
        best = None
        for reach in (TOUCH_NEAR, TOUCH_FAR):
            cand = []
            for r in rows:
                g = gap(r, p)
                if g > reach or r["class_id"] == TIE_CLASS:
                    continue
                other = min((gap(r, q) for k, q in hands.items() if k != h), default=np.inf)
                if g > 0.05 and other * DUAL_RATIO < g:
                    continue
                w = worth(r, h)
                if w is not None:
                    cand.append((-g / TOUCH_NEAR + 0.10 * w, -int(r["detection_id"]), r))
            if cand:
                best = max(cand, key=lambda c: c[:2])[2]
                break
        if best is not None:
            put(h, best)
    for slot in ("left_eye", "right_eye", *(s for s in SLOT_ZONES if not s.endswith("_eye"))):
        fit = [(worth(r, slot), r) for r in rows if int(r["detection_id"]) not in used and r[f"in_{slot}"]]
        fit = [(w, -int(r["detection_id"]), r) for w, r in fit if w is not None]
        if out[slot] is None and fit:
            put(slot, max(fit, key=lambda c: c[:2])[2])
    return [{"image_id": int(first["image_id"]), **out}]


# ---------------------------------------------------------------- orderings
def greedy_walk(x: np.ndarray, start: int = 0, reach: float = np.inf) -> list[int]:
    """Nearest unvisited next, ties to the lower row; ends where the next is farther than ``reach``."""
    left = np.ones(len(x), bool)
    path, at = [start], start
    left[start] = False
    while left.any():
        d = np.where(left, np.linalg.norm(x - x[at], axis=1), np.inf)
        nxt = int(d.argmin())
        if d[nxt] > reach:
            break
        path.append(nxt)
        left[nxt] = False
        at = nxt
    return path


def two_opt(x: np.ndarray, path: list[int], passes: int = 6) -> list[int]:
    """A shorter tour with fixed ends: reversals that save length, best first per pass."""
    p = np.array(path)
    for _ in range(passes):
        better = False
        for i in range(1, len(p) - 2):
            a, b = x[p[i - 1]], x[p[i]]
            tail = x[p[i + 1 : -1]]
            nxt = x[p[i + 2 :]]
            gain = np.linalg.norm(a - b) + np.linalg.norm(tail - nxt, axis=1) - np.linalg.norm(tail - a, axis=1) - np.linalg.norm(nxt - b, axis=1)
            if len(gain) and gain.max() > 1e-9:
                j = i + 1 + int(gain.argmax())
                p[i : j + 1] = p[i : j + 1][::-1]
                better = True
        if not better:
            break
    return p.tolist()


def skip_detours(x: np.ndarray, path: list[int], factor: float = 3.0) -> list[int]:
    """The path without inner points whose detour costs more than ``factor`` times the mean step."""
    if len(path) < 3:
        return path
    steps = np.linalg.norm(np.diff(x[path], axis=0), axis=1)
    bar = factor * steps.mean()
    out = [path[0]]
    for i in range(1, len(path) - 1):
        extra = np.linalg.norm(x[path[i]] - x[out[-1]]) + np.linalg.norm(x[path[i + 1]] - x[path[i]]) - np.linalg.norm(x[path[i + 1]] - x[out[-1]])
        if extra <= bar:
            out.append(path[i])
    return [*out, path[-1]]
