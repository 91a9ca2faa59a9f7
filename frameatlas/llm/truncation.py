"""Text values whose end was lost, by field limit or in transfer.

Nobody says which values are cut, so positives are made: intact-looking values are
cut at random places (transfer) or with their end laid on the field limit, some with
an ellipsis mark.  A hashed logistic regression learns closing characters, closing
words, punctuation, bracket balance, the form of what follows the record's own key,
and the distance to the source's limit.  It is fitted twice: values the first model,
trained on the other half, takes for cut do not count as intact the second time.

Limits are found per source and field from exact length counts: a length that stands
out fourfold over the twenty lengths below it and that almost nothing passes, or that
nothing passes and that stands out clearly (four times the root of what is usual), and
that less than three values in five have (else it is simply the form of the value).
Lengths are counted in letters and in bytes; the unit that shows more values counts.  The
same counts tell titles from texts: where a field's lengths fall into a short and a
long group with a valley between them, values below the valley are titles, complete
without a final mark, and none of them is cut to make a positive.  How common cuts
are differs by source, so the scores of all rows are counted per source and the share
of cut values is fitted to them (expectation maximisation) before a row is decided.

Features are built for whole Arrow batches at a time: letters, words and sources are
hashed as arrays, and the hashes index one weight array per field.  Training takes the
values of about ``sample_rows`` records (by hash); limits, word counts, valleys, shares
and scores cover all rows and whole texts.  Word counts are kept in 2**16 hashed slots; limits and shares stay tables, one
row per source and field, and are joined without a hint.

Defined cases: null and empty values are not output; a null source is a source of its
own; a field from which no positive can be made has null scores and no cut value;
repeated rows get equal decisions; a table without values gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from frameatlas.runtime import hash_sample, materialize, single_blas_thread, table

BITS = 16
SLOTS = 1 << BITS
NONE = SLOTS  # the slot of a feature that a row lacks; it weighs nothing
END = 48  # closing letters that closing features look at
MARKS = ".!?…\"')”"
_HEX, _NUM = re.compile(r"[0-9a-f]{16}"), re.compile(r"[0-9]+")
_REFERENCE = re.compile(r"(?<==)[^=&\n]*[a-z][^=&\n]*(?=\n)")
_ENTITY, _PERCENT = re.compile(r"&[^;]{0,6}$"), re.compile(r"%[0-9A-Fa-f]?$")
# letters 1, digits 2, anything else 0
_KIND = np.array([1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 0 for i in range(0xD800)], np.uint8)
_POWER = np.array([pow(1_000_003, i + 1, 1 << 32) for i in range(64)], np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds(code: np.ndarray) -> np.ndarray:
    return _KIND[np.where(code < len(_KIND), code, 0)]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower case) and the text each stands in, in order."""
    code = _codes("\0".join(t.replace("\0", " ") for t in texts).lower() + "\0")
    inside = _kinds(code) > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    since = np.zeros(len(code), np.int64)
    since[starts] = starts
    np.maximum.accumulate(since, out=since)
    value = np.where(inside, code * _POWER[(np.arange(len(code)) - since) & 63], 0).astype(np.uint32)
    h = np.add.reduceat(value, starts, dtype=np.uint32)
    return h ^ (h >> np.uint32(15)), np.cumsum(code == 0)[starts]


def _slot(*parts) -> np.ndarray:
    h = np.uint32(0)
    for p in parts:
        h = (h ^ np.atleast_1d(p).astype(np.uint32)) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        h = h ^ (h >> np.uint32(15))
    return (h & np.uint32(SLOTS - 1)).astype(np.int32)


def _strings(texts) -> np.ndarray:
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint32)


def features(texts: list[str], sources: list[str], to_limit: np.ndarray, keys: list[str | None], companions: list[str | None], short: int, classes: np.ndarray) -> np.ndarray:
    """Slots of what is seen at the end of every value, one column per kind of sight.

    ``to_limit`` is nan without a limit, ``short`` the field's valley, ``classes`` how
    common the words of each slot are.
    """
    n = len(texts)
    ends = [t[-END:] for t in texts]
    last4 = _codes("".join(t[-4:].rjust(4, "\0") for t in texts)).reshape(n, 4)
    c1, kind = last4[:, 3], _kinds(last4[:, 3])
    shown = np.where(kind > 0, kind, c1)  # any letter, any digit, or the very sign
    h, of = words_of(ends)
    at = np.searchsorted(of, np.arange(n), "right") - 1
    mine = lambda k: (k >= 0) & (of[np.maximum(k, 0)] == np.arange(n)) if len(of) else np.zeros(n, bool)
    word = np.where(mine(at), h[at] if len(h) else 0, 0).astype(np.uint32)
    prev = np.where(mine(at - 1), h[at - 1] if len(h) else 0, 0).astype(np.uint32)
    seen = np.where(word > 0, classes[_slot(word)], 0)
    final = np.isin(c1, [ord(c) for c in MARKS])
    one, which = np.unique(np.array(sources, object).astype(str), return_inverse=True)
    src = _strings(one)[which]
    near = np.select([np.isnan(to_limit), to_limit <= 0, to_limit < 4], [0, 1, 2], 3)
    length = np.array([len(t) for t in texts])
    size = np.where(length < short, 99, np.floor(np.log2(length + 1)))
    flag = lambda f: np.array([f(t) for t in texts], bool)
    ellipsis = flag(lambda t: t.endswith(("...", "…")))
    cols = [
        (size, final), (size, src, final), (near,), (src, near), (src, shown), (shown, near), (last4[:, 2], c1), (last4[:, 1], last4[:, 2], c1), (src, last4[:, 0], last4[:, 1], last4[:, 2], c1),
        (word,), (prev, word), (word, np.where(kind > 0, 0, c1)), (src, final), (final, near), (seen, final), (src, seen),
        (flag(lambda t: t.count("(") > t.count(")")),), (flag(lambda t: "&" in t[-7:] and bool(_ENTITY.search(t))),), (flag(lambda t: "%" in t[-2:] and bool(_PERCENT.search(t))),),
        (ellipsis, near), (np.isin(c1, [ord(c) for c in " \t\n\r,-–&("]),),
    ]
    out = np.full((n, len(cols) + 4), NONE, np.int32)
    for j, parts in enumerate(cols):
        out[:, j] = _slot(np.uint32(j + 1), *parts)
    keyed = np.array([i for i, k in enumerate(keys) if k], int)
    if len(keyed):
        found = [texts[i].find(keys[i]) for i in keyed]
        rest = ["-" if a < 0 else texts[i][a + len(keys[i]) :].replace("\n", " ") for i, a in zip(keyed, found)]
        form = _NUM.sub("9", _HEX.sub("H", "\n".join(rest) + "\n"))
        if "H" in form:
            form = "\n".join(_REFERENCE.sub("S", f + "\n")[:-1] if "H" in f else f for f in form[:-1].split("\n")) + "\n"
        has = np.array(found) >= 0
        h2, of2 = words_of([companions[i] or "" for i in keyed])
        known = np.isin((np.arange(len(keyed), dtype=np.int64) << 32) | word[keyed], (of2.astype(np.int64) << 32) | h2)
        for j, parts in enumerate([(has,), (src[keyed], _strings(form[:-1].split("\n"))), (src[keyed], np.array([len(t) for t in rest])), (known, has, src[keyed])]):
            out[keyed, len(cols) + j] = _slot(np.uint32(len(cols) + j + 1), *parts)
    return out


def _source(site: str) -> Column:
    return F.coalesce(F.col(site).cast("string"), F.lit("?"))


def values(df: DataFrame, item: str, site: str, fields: dict[str, str | None], companion: str) -> DataFrame:
    """``item, source, field_name, text, key, companion``: one row per non-empty value."""
    text = lambda k: F.nullif(F.col(k).cast("string"), F.lit(""))
    one = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text"), (text(k) if k else F.lit(None).cast("string")).alias("key"), (F.col(companion) if k else F.lit(None).cast("string")).alias("companion")) for f, k in fields.items()]
    return df.select(F.col(item).alias("item"), _source(site).alias("source"), F.explode(F.array(*one)).alias("v")).select("item", "source", "v.*").where("text is not null and text <> ''")


def length_counts(vals: DataFrame) -> DataFrame:
    """``source, field_name, unit, len, n``: how many values have a length in letters (unit ``c``) or in UTF-8 bytes (``b``)."""
    both = F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.length("text").alias("len")), F.struct(F.lit("b").alias("unit"), F.octet_length("text").alias("len"))))
    return vals.select("source", "field_name", both.alias("l")).groupBy("source", "field_name", "l.unit", "l.len").agg(F.count("*").alias("n"))


def field_limits(counts: DataFrame) -> DataFrame:
    """``source, field_name, unit, limit`` from exact counts of all values; of two units the one in which more values end at the limit."""
    key = ["source", "field_name", "unit"]
    by = W.partitionBy(*key).orderBy("len")
    near = F.coalesce(F.sum("n").over(by.rangeBetween(-20, -1)), F.lit(0)) / 20
    above = F.sum("n").over(W.partitionBy(*key).orderBy(F.col("len").desc())) - F.col("n")
    total = F.sum("n").over(W.partitionBy(*key))
    hit = counts.select(*key, "len", "n", near.alias("near"), above.alias("above"), total.alias("total")).where("n >= 5 and n <= 0.6 * total and (n >= 4 * near and above <= 0.01 * total or above = 0 and n >= near + 4 * sqrt(near))")
    one = hit.groupBy(*key).agg(F.max(F.struct("len", "n")).alias("m"))
    return one.groupBy("source", "field_name").agg(F.max(F.struct(F.col("m.n").alias("n"), F.col("unit"), F.col("m.len").alias("len"))).alias("m")).select("source", "field_name", "m.unit", F.col("m.len").alias("limit"))


def size_in(unit: str | None, text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass")) if unit == "b" else len(text)


def valley(lengths: np.ndarray, counts: np.ndarray) -> int:
    """The length between a group of short and one of long values; 0 where there is none.

    Counts are averaged over five lengths; the lowest place between two peaks must lie
    below a quarter of both.
    """
    if not len(lengths):
        return 0
    whole = np.zeros(int(lengths.max()) + 6)
    np.add.at(whole, lengths.astype(int), counts)
    smooth = np.convolve(whole, np.ones(5) / 5, "same")
    left, right = np.maximum.accumulate(smooth), np.maximum.accumulate(smooth[::-1])[::-1]
    depth = np.minimum(left, right) - 4 * smooth
    # a group is more than a stray value: each side holds a twentieth of all
    share = np.cumsum(whole) / max(1, whole.sum())
    depth[(share < 0.05) | (share > 0.95)] = -1
    best = depth.max(initial=-1)
    if best <= 0:
        return 0
    flat = np.flatnonzero(depth >= best - 1e-9)
    return int(flat[len(flat) // 2])


def word_slots(vals: DataFrame) -> DataFrame:
    """``field_name, slot, share``: how often a word stands before a value's last one, by hashed word, over the number of values."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            field = np.array(b.column("field_name").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for f in set(field):
                h, of = words_of([texts[i] for i in np.flatnonzero(field == f)])
                inner = np.append(of[1:] == of[:-1], False)[: len(of)]
                counts[f] = counts.get(f, 0) + np.bincount(_slot(h[inner]), minlength=SLOTS)
        for f, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["field_name", "slot", "n"])

    n = vals.groupBy("field_name").agg(F.count("*").alias("of"))
    slots = vals.select("field_name", "text").mapInArrow(run, "field_name string, slot int, n long").groupBy("field_name", "slot").agg(F.sum("n").alias("n"))
    return slots.join(n, "field_name").select("field_name", "slot", (F.col("n") / F.col("of")).alias("share"))


def _classes(slots: pd.DataFrame) -> np.ndarray:
    """How common the words of a slot are, in four classes."""
    out = np.zeros(SLOTS, np.int8)
    out[slots.slot.to_numpy(int)] = np.searchsorted([2e-5, 2e-4], slots.share.to_numpy(), "right") + 1
    return out


def made(rows: pd.DataFrame, short: int, rng: np.random.Generator) -> pd.DataFrame:
    """Training rows: every value below its limit as it is (y = 0) and cut in one or two ways (y = 1)."""
    out = []
    for item, s, t, limit, unit, key, comp in rows[["item", "source", "text", "limit", "unit", "key", "companion"]].itertuples(index=False):
        bound = limit == limit and limit is not None
        left = lambda x: limit - size_in(unit, x) if bound else np.nan  # noqa: B023, E731
        if bound and left(t) <= 0:
            continue
        brief = len(t) < short
        out.append((item, s, t, 0.0 if bound and rng.random() < 0.02 else left(t), key, comp, 0, brief))
        for mode in ("transfer", "limit") if bound else ("transfer",):
            if brief or len(t) < 2:
                continue
            cut = t[: int(rng.integers(max(1, len(t) // 3, short - 2), len(t)))]
            if rng.random() < 0.25 and " " in cut.strip():
                cut = cut.rstrip().rsplit(" ", 1)[0]
            if mode == "limit":
                u = rng.random()
                cut = cut.rstrip() + "..." if u < 0.12 else cut.rstrip() + "…" if u < 0.24 else cut
            if cut:
                out.append((item, s, cut, 0.0 if mode == "limit" else left(cut), key, comp, 1, brief))
    return pd.DataFrame(out, columns=["item", "source", "text", "to_limit", "key", "companion", "y", "brief"])


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 25, l2: float = 3e-6, memory: int = 8) -> np.ndarray:
    """Logistic regression over hashed features with a penalty, so that rare slots weigh little (limited-memory BFGS); the last slot stays 0."""
    n, cols = SLOTS + 1, np.ascontiguousarray(x.T, dtype=np.intp)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z, g = np.zeros(len(y)), l2 * w
        for c in cols:
            z += w.take(c)
        r = (1 / (1 + np.exp(-z)) - y) / len(y)
        for c in cols:
            g += np.bincount(c, r, n)
        g[-1] = 0
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (w @ w)), g

    w = np.zeros(n)
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d = -g
        used = []
        for s, t, r in reversed(past):
            a = r * (s @ d)
            used.append(a)
            d = d - a * t
        if past:
            d = d * (1 / (past[-1][2] * (past[-1][1] @ past[-1][1])))
        for (s, t, r), a in zip(past, reversed(used)):
            d = d + (a - r * (t @ d)) * s
        step, slope = (1.0 if past else 1 / max(1e-12, np.abs(g).sum())), g @ d
        for _ in range(20):
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = step * d, g2 - g
        w, gain, f, g = w + s, f - f2, f2, g2
        if s @ t > 1e-12:
            past = [*past, (s, t, 1 / (s @ t))][-memory:]
        if gain < 1e-5 * abs(f):
            break
    return w


def train(item: np.ndarray, x: np.ndarray, y: np.ndarray, brief: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float] | None:
    """Weights and prior log odds; None without both kinds of rows.

    ``x``: feature ids per row; ``brief``: made from a title.
    """
    if not (y == 1).any() or not (y == 0).any():
        return None
    single_blas_thread()
    rng = np.random.default_rng(seed)
    _, own = np.unique(item, return_inverse=True)
    half = rng.integers(0, 2, own.max() + 1)[own]
    keep = np.ones(len(y), bool)
    for _ in range(2):
        doubt = np.zeros(len(y), bool)
        for a in (0, 1):
            use, test = keep & (half == a), half != a
            if use.any() and len(set(y[use])) == 2:
                doubt[test] = (y[test] == 0) & (_fit(x[use], y[use])[x[test]].sum(1) > 0.0)
        keep = ~doubt | (brief & (y == 0))  # titles stay intact whatever the model thinks
    gone = np.zeros(own.max() + 1, bool)
    gone[own[~keep]] = True
    keep = ~gone[own]  # nothing made from a doubtful value trains
    if len(set(y[keep])) < 2:
        return None
    return _fit(x[keep], y[keep]), float(np.log((y[keep] == 1).sum() / (y[keep] == 0).sum()))


def _share(counts: np.ndarray, logits: np.ndarray) -> float:
    """Share of cut values in a source from its counted logits (prior-free): expectation maximisation."""
    r = np.exp(np.clip(logits, -30, 30))
    p = 0.05
    for _ in range(200):
        q = p * r / (p * r + 1 - p)
        p = float(np.clip((counts * q).sum() / max(1, counts.sum()), 1e-4, 0.9))
    return p


def _prior(pdf: pd.DataFrame) -> pd.DataFrame:
    p = _share(pdf.n.to_numpy(), pdf.bin.to_numpy() / 4)
    return pd.DataFrame({"source": pdf.source.iloc[:1], "field_name": pdf.field_name.iloc[:1], "prior": [float(np.log(p / (1 - p)))]})


def cut_values(df: DataFrame, item: str, site: str, fields: dict[str, str | None], companion: str, sample_rows: int = 20_000) -> DataFrame:
    """``item, source, field_name, logit, truncated``: one row per non-empty value.

    ``fields`` names for each field the column whose whole value an intact value
    contains (or None).
    """
    spark = df.sparkSession
    vals = values(df, item, site, fields, companion)
    counts = materialize(length_counts(vals), "cut-lengths")
    limits = materialize(field_limits(counts.df), "cut-limits")
    pooled = counts.df.where("unit = 'c'").groupBy("field_name", "len").agg(F.sum("n").alias("n")).toPandas()  # one row per length
    counts.drop()
    slots = word_slots(vals).toPandas()  # at most SLOTS rows per field
    told = lambda d: d.join(limits.df, ["source", "field_name"], "left")
    few = hash_sample(df.select(item, site, *dict.fromkeys([*fields, *filter(None, fields.values()), companion])), item, sample_rows)
    sample = told(values(few, item, site, fields, companion)).toPandas().sort_values(["item", "field_name", "text"], kind="stable")
    models = {}
    for f, key in fields.items():
        classes = _classes(slots[slots.field_name == f])
        # a value that holds a key is no title
        short = 0 if key else valley(*(pooled[pooled.field_name == f][c].to_numpy() for c in ("len", "n")))
        rows = made(sample[sample.field_name == f].astype({"key": object, "companion": object, "unit": object}).replace({np.nan: None}), short, np.random.default_rng(11))
        if len(rows):
            x = features(rows.text.tolist(), rows.source.tolist(), rows.to_limit.to_numpy(float), rows.key.tolist(), rows.companion.tolist(), short, classes)
            fitted = train(rows.item.to_numpy(), x, rows.y.to_numpy(float), rows.brief.to_numpy(bool))
            if fitted:
                models[f] = (short, classes, *fitted)
    shared = spark.sparkContext.broadcast(models)  # less than a MB per field

    def run(batches):
        for b in batches:
            field = np.array(b.column("field_name").to_pylist(), object)
            col = {c: b.column(c).to_pylist() for c in ("source", "text", "key", "companion", "unit")}
            limit = b.column("limit").to_numpy(zero_copy_only=False).astype(float)
            logit = np.full(b.num_rows, np.nan)
            for f, (short, classes, w, base) in shared.value.items():
                own = np.flatnonzero(field == f)
                if len(own):
                    v = {c: [x[i] for i in own] for c, x in col.items()}
                    left = limit[own] - np.array([size_in(u, t) for u, t in zip(v["unit"], v["text"])])
                    logit[own] = w[features(v["text"], v["source"], left, v["key"], v["companion"], short, classes)].sum(1) - base
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("source"), b.column("field_name"), pa.array(logit, mask=np.isnan(logit))], names=["item", "source", "field_name", "logit"])

    rows = told(vals).select(F.col("item").cast("long").alias("item"), "source", "field_name", "text", "key", "companion", "unit", F.col("limit").cast("double").alias("limit"))
    scored = materialize(rows.mapInArrow(run, "item long, source string, field_name string, logit double"), "cut-scores").df
    priors = scored.where("logit is not null").groupBy("source", "field_name", F.round(F.col("logit") * 4).alias("bin")).agg(F.count("*").alias("n")).groupBy("source", "field_name").applyInPandas(_prior, "source string, field_name string, prior double")
    return scored.join(priors, ["source", "field_name"], "left").select("item", "source", "field_name", "logit", F.coalesce(F.col("logit") + F.col("prior") > 0, F.lit(False)).alias("truncated"))


def _images(spark, sf_dir: str) -> DataFrame:
    return cut_values(table(spark, sf_dir, "images"), "image_id", "site_name_id", {"description": None, "contenturl": "site_image_id"}, "description")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).where("truncated").select(F.col("item").alias("image_id"), "field_name")


def p5_site_rates(spark, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).groupBy("source", "field_name").agg(F.count("*").alias("n_values"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("int")), 6).alias("rate"))


def p5_values(spark, sf_dir: str) -> DataFrame:
    """Values looked at per site and field, and how many got no score (none may)."""
    return _images(spark, sf_dir).groupBy("source", "field_name").agg(F.count("*").alias("n_values"), F.count_if(F.col("logit").isNull()).alias("n_unscored"))


QUERIES = {"p5_found": p5_found, "p5_site_rates": p5_site_rates, "p5_values": p5_values}
SQL = {
    "p5_values": """SELECT coalesce(CAST(site_name_id AS VARCHAR), '?') AS source, field_name, count(*) AS n_values, 0 AS n_unscored
  FROM (SELECT site_name_id, 'description' AS field_name, description AS v FROM images UNION ALL SELECT site_name_id, 'contenturl', contenturl FROM images) AS x WHERE v IS NOT NULL AND v <> '' GROUP BY 1, 2"""
}
