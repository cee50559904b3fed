"""License scans by ordered signature rules, within DataFrame functions.

A document is a candidate if it contains a gate word's letters at all; only then are its
words laid out. Each gate word there opens the rules behind it, which see the words within
``REACH`` of the gate. A rule whose hint is absent from them is not tried. Detections are
intervals of words. Overlaps are resolved by priority first, then length, then place: a
detection that overlaps a better one which stays is suppressed, contained or not, and one
that only overlaps suppressed ones stays.

Base phrases are reported wherever they stand and are never suppressed.

Everything happens within the row: no shuffle and no join. Detections are sorted once and
cut into runs that don't overlap, so the work grows with their number and not its square.
Defined cases: a null text is empty; no gate word gives no labels, null positions and score
0; detections that are equal in every respect count once; repeated rows are scanned each;
an empty table gives an empty result; columns named like a result are replaced, all others
kept.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, best_apart, distinct_sorted, documents, let, packed, record, unpacked, whole_text
from .license_rules import Rule, base_rules, rules

REACH = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DETECTION = "struct<start:int,end:int,priority:int,label:string,confidence:double>"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]


def word_array(text: Column) -> Column:
    """The text between separators, with an empty string at both ends."""
    return F.split(F.concat(F.lit(" "), text, F.lit(" ")), SEPARATORS)


def _table(listed: list[Rule]) -> Column:
    """Gate word to its rules, as one constant."""
    gates = {g: [r._asdict() for r in listed if r.gate == g] for g in sorted({r.gate for r in listed})}
    return F.from_json(F.lit(json.dumps(gates)), "map<string,array<struct<pattern:string,hint:string,label:string,priority:int,confidence:double>>>")


def candidate(text: Column, listed: list[Rule]) -> Column:
    """Whether any gate word may occur: letters first, and for short gates a look at the letters beside."""
    gates = sorted({r.gate for r in listed}, key=len)
    stems: list[str] = []
    for g in gates:
        if len(g) > 3 and not any(s in g for s in stems):
            stems.append(g)
    low = F.lower(text)
    short = "|".join(g for g in gates if len(g) <= 3)
    hit = low.contains(stems[0])
    for s in stems[1:]:
        hit = hit | low.contains(s)
    return hit | text.rlike(f"(?i)(?<![a-z0-9])(?:{short})(?![a-z0-9])")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(words: Column, listed: list[Rule]) -> Column:
    """All detections of the rules, each once, sorted by start and end. ``words`` has its empty ends."""
    gates = F.array(*[F.lit(g) for g in sorted({r.gate for r in listed})])
    anchors = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(gates, w), record(i=i, w=w))), lambda a: a.isNotNull())

    def around(anchor: Column) -> Column:
        first = F.greatest(F.lit(1), anchor["i"] - REACH)  # the first word stands behind the empty end
        left = F.array_join(F.slice(words, first + 1, anchor["i"] - first), " ")
        right = F.array_join(F.slice(words, anchor["i"] + 1, F.lit(REACH)), " ")
        return F.concat(F.lit(" "), left, F.lit("@"), right, F.lit(" "))

    def by_rule(anchor: Column, seen: Column, table: Column) -> Column:
        def tried(rule: Column) -> Column:
            m = F.when(F.contains(seen, rule["hint"]), F.call_function("regexp_extract", seen, rule["pattern"], F.lit(0))).otherwise(F.lit(""))
            return record(m=m, rule=rule)

        hits = F.filter(F.transform(F.element_at(table, anchor["w"]), tried), lambda x: x["m"] != "")
        return F.transform(
            hits,
            lambda x: record(
                start=(anchor["i"] - 1 - _blanks(F.substring_index(x["m"], "@", 1))).cast("int"),
                end=(anchor["i"] + _blanks(F.substring_index(x["m"], "@", -1))).cast("int"),
                priority=x["rule"]["priority"], label=x["rule"]["label"], confidence=x["rule"]["confidence"],
            ),
        )

    found = let(_table(listed), lambda t: F.flatten(F.transform(anchors, lambda a: let(around(a), lambda seen: by_rule(a, seen, t)))))
    return distinct_sorted(found)


def surviving(found: Column) -> Column:
    """Sorted detections without those that overlap a better one which stays."""
    return best_apart(found, lambda d: record(priority=d["priority"], shorter=d["start"] - d["end"], start=d["start"], label=d["label"]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, base_labels, labels, score and n_detections."""
    base, listed = base_rules(), rules()
    rows = packed(docs).withColumn("whole", whole_text(F.col(f"row.`{text}`")))
    rows = rows.withColumn("n_words", (F.size(word_array(F.col("whole"))) - 2).cast("long"))
    words = F.when(candidate(F.col("whole"), base + listed), word_array(ascii_lower(F.col("whole"))))
    rows = rows.withColumn("words", words)
    rows = rows.withColumn("base", F.when(F.col("words").isNotNull(), detections(F.col("words"), base)))
    rows = rows.withColumn("found", F.when(F.col("words").isNotNull(), surviving(detections(F.col("words"), listed))))
    none = F.array().cast(f"array<{_DETECTION}>")
    base_found, own = F.coalesce("base", none), F.coalesce("found", none)

    def names(a: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")

    starts = F.transform(base_found, lambda d: d["start"])
    every = F.concat(base_found, own)
    results = {
        "n_words": F.col("n_words"),
        "n_base": F.size(base_found).cast("long"),
        "first_word": F.array_min(starts).cast("long"),
        "last_word": F.array_max(starts).cast("long"),
        "base_labels": names(base_found),
        "labels": names(every),
        "score": F.coalesce(F.array_max(F.transform(every, lambda d: d["confidence"])), F.lit(0.0)),
        "n_detections": F.size(own).cast("long"),
    }
    return rows.select(*unpacked("row", docs.columns, RESULTS), *[results[k].alias(k) for k in RESULTS])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def _values(listed: list[Rule]) -> str:
    """Rules as SQL rows; the blank that must follow a match is matched and not looked ahead at."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(r.gate)}, {quoted(r.hint)}, {quoted(r.pattern.replace('(?= )', ' '))}, {quoted(r.label)}, {r.priority}, {r.confidence})" for r in listed)


def oracle_sql() -> str:
    """The same in DuckDB: rules joined to gate words, and suppression by recursion over the ranked detections of a text."""
    base, listed = base_rules(), rules()
    gates = ", ".join(f"'{g}'" for g in sorted({r.gate for r in base + listed}))
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    left, right = "split_part(m, '@', 1)", "split_part(m, '@', 2)"
    return f"""
WITH RECURSIVE rule(gate, hint, pattern, label, priority, confidence) AS (VALUES {_values(base + listed)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
a AS (SELECT rid, ws, unnest(list_filter(range(0, len(ws)), lambda k: list_contains([{gates}], ws[k + 1]))) AS k FROM d),
s AS (SELECT rid, k, ws[k + 1] AS gate, ' ' || array_to_string(ws[greatest(1, k - {REACH - 1}):k], ' ') || '@' || array_to_string(ws[k + 1:k + {REACH}], ' ') || ' ' AS seen FROM a),
h AS (SELECT rid, k, label, priority, confidence, regexp_extract(seen, pattern) AS m FROM s JOIN rule USING (gate) WHERE contains(seen, hint)),
f AS MATERIALIZED (SELECT DISTINCT rid, k - {blanks(left)} AS start, k + {blanks(right)} AS stop, priority, label, confidence::DOUBLE AS confidence FROM h WHERE m <> ''),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY priority, start - stop, start, label, confidence) AS rk FROM f WHERE priority > 0),
g AS (SELECT DISTINCT rid, 0::BIGINT AS rk, []::STRUCT(a BIGINT, b BIGINT, l VARCHAR, c DOUBLE)[] AS kept FROM o
 UNION ALL SELECT o.rid, o.rk, CASE WHEN len(list_filter(kept, lambda x: x.a < stop AND start < x.b)) > 0 THEN kept ELSE list_append(kept, {{'a': start, 'b': stop, 'l': label, 'c': confidence}}) END FROM g JOIN o ON o.rid = g.rid AND o.rk = g.rk + 1),
own AS (SELECT rid, unnest(kept) AS x FROM (SELECT rid, arg_max(kept, rk) AS kept FROM g GROUP BY 1)),
every AS (SELECT rid, x.l AS label, x.c AS c, true AS own, NULL::BIGINT AS start FROM own UNION ALL SELECT rid, label, confidence, false, start FROM f WHERE priority = 0),
t AS (SELECT rid, count(*) FILTER (NOT own) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (NOT own) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score, count(*) FILTER (own) AS n_detections FROM every GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score,
 coalesce(n_detections, 0)::BIGINT AS n_detections FROM d LEFT JOIN t USING (rid)
"""
