"""Free-entered values mapped to the entries of a reference list, in SQL only.

Every reference entry has *variants* (its names, other word orders, codes).  A
typed value has *forms* (the whole, the part before a bracket, the last part after
a comma or slash).  Both are normalised: lower case, accents removed, only letters
and digits kept.  All pairs come from one partition-based pigeonhole join: a variant
is cut into k + 1 segments, and a string within k edits must contain one of them
unchanged, shifted by at most k.  Segments are joined by equality with positional
substrings of the typed values, the surviving pairs are verified with
``levenshtein``, and values left over by the final anti-join are reported with
reference -1.

Two slips are forgiven in words of eight letters or more, one in words of five to
seven, none below and none in codes.  A transposition costs two edits but is one slip,
so slips are ``bag + (edits - bag) / 2`` where ``bag`` is the letter-multiset
difference (a lower bound of the edits that transpositions don't touch).  Slips that
are transpositions only leave the letters the same, so one more segment, the sorted
letters, finds them; what remains has at most k = 3, 1 and 0 edits.  Segments
therefore have two letters at least.

Scale: only distinct typed strings enter the join, each with a few dozen short keys,
so a value typed by a third of all rows is one string; the reference list is
joined by key, never crossed.  Ties go to fewer slips, fewer edits, smaller id.

Defined cases: null and blank values are not output; values equal byte for byte
to a listed entry are not output; an empty reference list maps every value to -1;
very long texts have as many substrings as letters and match nothing but themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameatlas.llm.canon_words import GENDER_VARIANTS
from frameatlas.runtime import materialize, partitions_for, table

MOST = 4  # edits of two slips
ACCENTED = "áàâäãåéèêëíìîïóòôöõøúùûüýñçšžğı"
PLAIN = "aaaaaaeeeeiiiioooooouuuuyncszgi"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def norm(x: str) -> str:
    """SQL text shared by both dialects: lower, accents off, letters and digits only."""
    return f"regexp_replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', '{{g}}')"


def norm_spark(x: str) -> str:
    return norm(x).replace(", '{g}')", ", '')")


def norm_duck(x: str) -> str:
    return norm(x).replace(", '{g}')", ", '', 'g')")


# what the dialects write differently
SPARK = {"norm": norm_spark, "re": lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}')", "last": lambda x: f"element_at(split({x}, '[,/]'), -1)", "nblank": lambda x: f"{x} rlike '[^ \\\\t\\\\r\\\\n]'"}
DUCK = {"norm": norm_duck, "re": lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')", "last": lambda x: f"list_extract(regexp_split_to_array({x}, '[,/]'), -1)", "nblank": lambda x: f"regexp_matches({x}, '[^ \\t\\r\\n]')"}


def variants_sql(d: dict, kind: str) -> str:
    """``ref_id, variant, fuzzy`` of one reference list; fuzzy variants take part in the approximate join."""
    n = d["norm"]
    if kind == "country":
        named = " UNION ALL ".join(f"SELECT location_id AS ref_id, {c} AS raw, true AS fuzzy FROM locations" for c in ("getty_name", "nation_name", "nation_name_alpha", "official_nation_name", "sovereignty"))
        swapped = f"SELECT location_id AS ref_id, concat(nation_name, ', ', {d['re']('official_nation_name', ' of .*', ' of')}) AS raw, true AS fuzzy FROM locations WHERE official_nation_name LIKE '% of %'"
        codes = " UNION ALL ".join(f"SELECT location_id AS ref_id, {c} AS raw, false AS fuzzy FROM locations" for c in ("code_alpha2", "code_alpha3", "code_iso"))
        return f"SELECT ref_id, {n('raw')} AS variant, fuzzy FROM ({named} UNION ALL {swapped} UNION ALL {codes}) AS v WHERE ref_id IS NOT NULL AND raw IS NOT NULL"
    words = ", ".join(f"('{w}', '{g}')" for g, ws in GENDER_VARIANTS.items() for w in ws)
    return f"""SELECT g.gender_id AS ref_id, {n('v.word')} AS variant, true AS fuzzy FROM genders AS g JOIN (VALUES {words}) AS v(word, gender) ON g.gender = v.gender
      UNION ALL SELECT gender_id, {n('gender')}, true FROM genders WHERE gender_id IS NOT NULL AND gender IS NOT NULL"""


def forms_sql(d: dict) -> str:
    """Distinct normalised forms of the distinct values, by precedence ``rank``."""
    open_text = d["re"]("value", r"[(].*?[)]|^ *[Tt]he ", " ")
    plain = d["re"](d["re"](open_text, "(?i)[^a-z](only|persons?|people)[^a-z]*$", " "), "^ *[Tt]he ", " ")
    last = d["re"](d["last"](open_text), "^ *[Tt]he ", " ")
    points = d["re"](d["re"](last, "^ *[Nn][.] *", "north "), "^ *[Ss][.] *", "south ")
    parts = [("value", 1), (open_text, 2), (plain, 3), (last, 4), (points, 5)]
    union = " UNION ALL ".join(f"SELECT field_name, value, {d['norm'](x)} AS form, {r} AS rank FROM typed" for x, r in parts)
    return f"SELECT field_name, value, form, min(rank) AS rank FROM ({union}) AS f WHERE form <> '' GROUP BY field_name, value, form"


BAG_SPARK = (
    "aggregate(split('" + LETTERS + "', ''), named_struct('p', 0, 'n', 0), (s, c) -> named_struct("
    "'p', s.p + greatest(0, length(replace(b, c, '')) - length(b) - length(replace(a, c, '')) + length(a)), "
    "'n', s.n + greatest(0, length(replace(a, c, '')) - length(a) - length(replace(b, c, '')) + length(b))), s -> greatest(s.p, s.n))"
)
BAG_DUCK = (
    "greatest(list_sum(list_transform(string_split('" + LETTERS + "', ''), lambda c: greatest(0, length(replace(b, c, '')) - length(b) - length(replace(a, c, '')) + length(a)))), "
    "list_sum(list_transform(string_split('" + LETTERS + "', ''), lambda c: greatest(0, length(replace(a, c, '')) - length(a) - length(replace(b, c, '')) + length(b)))))"
)
# slips allowed by the length of the variant, and edits that aren't transpositions only
ALLOWED = "CASE WHEN NOT fuzzy THEN 0 WHEN length(b) >= 8 THEN 2 WHEN length(b) >= 5 THEN 1 ELSE 0 END"
EDITS = "CASE WHEN NOT fuzzy THEN 0 WHEN length(variant) >= 8 THEN 3 WHEN length(variant) >= 5 THEN 1 ELSE 0 END"
SORTED = "array_join(array_sort(split({}, '')), '')"


def _match_tail(lev: str, bag: str, pairs: str) -> str:
    """From candidate pairs (field_name, value, rank, a, b, ref_id, fuzzy) to the best reference per value.

    With at most one edit the letters differ by just that, so only more edits, and no
    more than the allowed slips can explain, ask for the letter difference.
    """
    return f"""
near AS (SELECT field_name, value, ref_id, rank, lev, CASE WHEN lev <= 1 THEN lev * 1.0 ELSE {bag} + (lev - {bag}) / 2.0 END AS slips, allowed
   FROM (SELECT *, {lev} AS lev FROM (SELECT *, {ALLOWED} AS allowed FROM {pairs}) AS p) AS q WHERE lev BETWEEN 0 AND 2 * allowed),
best AS (SELECT field_name, value, ref_id FROM (
   SELECT *, row_number() OVER (PARTITION BY field_name, value ORDER BY CASE WHEN lev = 0 THEN 0 ELSE 1 END, slips, lev, rank, ref_id) AS rn FROM near WHERE slips <= allowed) AS r WHERE rn = 1)"""


def _typed(d: dict) -> str:
    ne = d["nblank"]
    return f"""SELECT DISTINCT 'country' AS field_name, country AS value FROM ingest_items WHERE country IS NOT NULL AND {ne('country')} AND country NOT IN (SELECT getty_name FROM locations WHERE getty_name IS NOT NULL)
      UNION ALL SELECT DISTINCT 'gender', gender FROM ingest_items WHERE gender IS NOT NULL AND {ne('gender')} AND gender NOT IN (SELECT gender FROM genders WHERE gender IS NOT NULL)"""


def map_values(spark: SparkSession, sf_dir: str, values_per_task: int = 1_000) -> DataFrame:
    """``(field_name, value, ref_id)`` for every distinct typed value that isn't a listed entry; -1 = none."""
    src = {t: table(spark, sf_dir, t) for t in ("ingest_items", "locations", "genders")}
    typed = spark.sql(_typed(SPARK).replace("FROM ingest_items", "FROM {ingest_items}").replace("FROM locations", "FROM {locations}").replace("FROM genders", "FROM {genders}"), **src)
    written = materialize(typed, "canon-typed")
    typed = written.df
    forms = materialize(spark.sql(forms_sql(SPARK).replace("FROM typed", "FROM {typed}"), typed=typed), "canon-forms").df
    tasks = partitions_for(written.rows(), values_per_task)
    variants = spark.sql(
        " UNION ALL ".join(f"SELECT '{k}' AS field_name, ref_id, variant, bool_or(fuzzy) AS fuzzy FROM ({variants_sql(SPARK, k)}) AS x WHERE variant <> '' GROUP BY ref_id, variant" for k in ("country", "gender")).replace("FROM locations", "FROM {locations}").replace("FROM genders", "FROM {genders}"),
        locations=src["locations"], genders=src["genders"],
    )
    variants = materialize(variants, "canon-variants").df
    # k + 1 segments of a variant; the first (length mod (k + 1)) of them are a letter longer
    segments = spark.sql(
        f"""SELECT field_name, ref_id, variant, fuzzy, k, start, substr(variant, start + 1, size) AS seg FROM (
              SELECT *, no * base + least(no, longer) AS start, base + if(no < longer, 1, 0) AS size FROM (
                SELECT *, length(variant) div (k + 1) AS base, length(variant) % (k + 1) AS longer FROM (SELECT *, {EDITS} AS k FROM {{variants}}) AS w) AS v
              LATERAL VIEW explode(sequence(0, k)) AS no) AS s
            UNION ALL SELECT field_name, ref_id, variant, fuzzy, -1, 0, {SORTED.format('variant')} FROM {{variants}} WHERE fuzzy AND length(variant) >= 5""",
        variants=variants,
    )
    # substrings as long as the segments of a variant may be whose length differs by at most k; k = 0 is the whole form
    grams = spark.sql(
        f"""SELECT field_name, value, form, rank, k, at, substr(form, at + 1, len) AS seg FROM (
              SELECT *, stack(2, 3, greatest(8, length(form) - 3) div 4, (length(form) + 3) div 4 + 1, 1, greatest(5, length(form) - 1) div 2, least(7, length(form) + 1) div 2 + 1) AS (k, least_len, most_len) FROM {{forms}} WHERE length(form) >= 4) AS f
              LATERAL VIEW explode(CASE WHEN most_len >= least_len AND length(form) >= least_len THEN sequence(least_len, least(most_len, length(form))) END) AS len
              LATERAL VIEW explode(sequence(0, length(form) - len)) AS at
            UNION ALL SELECT field_name, value, form, rank, 0, 0, form FROM {{forms}}
            UNION ALL SELECT field_name, value, form, rank, -1, 0, {SORTED.format('form')} FROM {{forms}} WHERE length(form) >= 5""",
        forms=forms,
    )
    pairs = spark.sql(
        """SELECT g.field_name, g.value, g.rank, g.form AS a, s.variant AS b, s.ref_id, s.fuzzy FROM {grams} AS g JOIN {segments} AS s
              ON g.field_name = s.field_name AND g.k = s.k AND g.seg = s.seg AND abs(g.at - s.start) <= greatest(g.k, 0) AND abs(length(g.form) - length(s.variant)) <= greatest(g.k, 0)""",
        grams=grams, segments=segments,
    )
    # a value is one however often it is typed; its pairs go to one of many tasks, and what follows stays there
    pairs = pairs.repartition(tasks, "value").distinct()
    tail = _match_tail("levenshtein(a, b, 2 * allowed)", BAG_SPARK, "{pairs}")
    best = spark.sql("WITH " + tail.strip() + " SELECT * FROM best", pairs=pairs)
    best = materialize(best, "canon-best").df
    return spark.sql(
        """SELECT field_name, value, ref_id FROM {best} UNION ALL
           SELECT t.field_name, t.value, CAST(-1 AS BIGINT) FROM {typed} AS t LEFT ANTI JOIN {best} AS b ON t.field_name = b.field_name AND t.value = b.value""",
        best=best, typed=typed,
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_values(spark, sf_dir)
    items = spark.sql("SELECT item_id, stack(2, 'country', country, 'gender', gender) AS (field_name, value) FROM {i}", i=table(spark, sf_dir, "ingest_items"))
    return spark.sql("SELECT i.item_id, i.field_name, m.ref_id FROM {i} AS i JOIN {m} AS m ON i.field_name = m.field_name AND i.value = m.value", i=items, m=mapped)


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand for nothing on the list, with the number of items that carry them."""
    found = map_values(spark, sf_dir)
    items = spark.sql("SELECT stack(2, 'country', country, 'gender', gender) AS (field_name, value) FROM {i}", i=table(spark, sf_dir, "ingest_items"))
    return spark.sql("SELECT i.field_name, i.value, count(*) AS n_items FROM {i} AS i JOIN {m} AS m ON i.field_name = m.field_name AND i.value = m.value WHERE m.ref_id = -1 GROUP BY i.field_name, i.value", i=items, m=found)


_DUCK = f"""typed AS ({_typed(DUCK)}),
forms AS ({forms_sql(DUCK)}),
variants AS ({" UNION ALL ".join(f"SELECT '{k}' AS field_name, ref_id, variant, bool_or(fuzzy) AS fuzzy FROM ({variants_sql(DUCK, k)}) AS x WHERE variant <> '' GROUP BY ref_id, variant" for k in ("country", "gender"))}),
cand AS (SELECT f.field_name, f.value, f.rank, f.form AS a, v.variant AS b, v.ref_id, v.fuzzy FROM forms AS f JOIN variants AS v ON f.field_name = v.field_name AND abs(length(f.form) - length(v.variant)) <= {MOST}),
{_match_tail("levenshtein(a, b)", BAG_DUCK, "cand").strip()},
mapped AS (SELECT t.field_name, t.value, coalesce(b.ref_id, -1) AS ref_id FROM typed AS t LEFT JOIN best AS b ON t.field_name = b.field_name AND t.value = b.value),
items AS (SELECT item_id, 'country' AS field_name, country AS value FROM ingest_items UNION ALL SELECT item_id, 'gender', gender FROM ingest_items)
"""
QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}
SQL = {
    "p6_found": f"WITH {_DUCK} SELECT i.item_id, i.field_name, m.ref_id FROM items AS i JOIN mapped AS m ON i.field_name = m.field_name AND i.value = m.value",
    "p6_unmatched": f"WITH {_DUCK} SELECT i.field_name, i.value, count(*) AS n_items FROM items AS i JOIN mapped AS m ON i.field_name = m.field_name AND i.value = m.value WHERE m.ref_id = -1 GROUP BY 1, 2",
}
