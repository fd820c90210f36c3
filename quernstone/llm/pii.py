"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. All in Spark SQL.

Spark returns the matched strings but not where they lie. Splitting the text with the same pattern gives the strings
between the matches, so running sums of both lengths give every span. Each pattern is written so that a match attempt
costs time in proportion to the run it looks at: a run is entered at its first character (or where the last match
ended, \\G) and taken possessively, which leaves the leftmost non-overlapping matches as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the base kinds, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# What a text must contain for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
# Words that make a proposal of the kind more likely when they stand shortly before it.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|amex|credit|payment",
    "phone": "phone|call|tel|mobile|fax|whatsapp",
    "iban": "iban|account|bank|transfer|konto",
    "ssn": "ssn|social|security",
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
CHECKED, NEARBY, WINDOW, THRESHOLD = 0.5, 0.15, 40, 0.4


def proposals(text: Column, kind: str) -> Column:
    """array<struct<s, b>>: matched strings with the string before each; a last one without s is what follows them."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1), lambda s, gap: F.struct(s.alias("s"), gap.alias("b")))
    guard = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(r"[0-9]")
    return F.when(guard, pairs).otherwise(F.array().cast("array<struct<s:string,b:string>>"))


def luhn(match: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(match, r"[\x20-]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), d.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(match: Column) -> Column:
    bare = F.regexp_replace(match, r"\x20", "")
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def valid(match: Column, kind: str) -> Column:
    """What a base kind must satisfy, or the checksum of an added one."""
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
        return F.forall(F.split(match, r"\."), lambda p: small(p) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(digits.between(14, 19), luhn(match)).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return match.isNotNull()


def located(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans of one kind, in code points, end exclusive."""
    prior = F.lit(PRIOR[kind] + (CHECKED if kind in ("card", "iban") else 0.0))

    def span(at, x):
        start = at + F.length(x["b"])
        near = F.lower(F.right(x["b"], F.lit(WINDOW))).rlike(rf"\b({CONTEXT[kind]})")
        score = prior + F.when(near, NEARBY).otherwise(0.0)
        return F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["s"])).alias("end"), score.alias("score")))

    def step(a, x):  # only confirmed spans are appended: other proposals only move the position on
        out = F.when(valid(x["s"], kind), F.concat(a["out"], span(a["at"], x))).otherwise(a["out"])
        return F.struct((a["at"] + F.length(x["b"]) + F.coalesce(F.length(x["s"]), F.lit(0))).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>").alias("out"))
    spans = F.aggregate(proposals(text, kind), zero, step, lambda a: a["out"])
    return spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= THRESHOLD)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda kind: F.array_position(F.lit(list(KINDS)), kind)
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("r"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Confirmed spans of each text: key, found_<kind> for each kind as array<struct<kind,start,end,score>>.

    Base kinds keep every span that passes their own test; iban needs its mod-97 check and ssn a word nearby, since
    score >= THRESHOLD. Defined cases: a null text is empty and has no spans; one row for each input row, repeated rows
    included; overlapping spans of different kinds all stay; other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), *[located(whole, kind).alias(f"found_{kind}") for kind in KINDS])


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    found = find_pii(docs)
    every = lambda kinds: F.concat(*[F.col(f"found_{k}") for k in kinds])
    return found.select(
        "doc_id",
        *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(every(BASE)), 256).alias("base_sha256"),
        joined(every(KINDS)).alias("spans"),
    )


def _oracle() -> str:
    """The plain patterns in DuckDB; positions again from the strings between the matches."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        # RE2 has no lookbehind: a word boundary stands for it where the class is that of words
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(s, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"
    bare = "replace(s, ' ', '')"
    code = "CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: {code})), lambda a, v: CASE WHEN v > 9 THEN a * 100 + v ELSE a * 10 + v END % 97) = 1"
    near = lambda kind: f"regexp_matches(lower(right(b, {WINDOW})), '\\b({CONTEXT[kind]})')"
    tests = {
        "email": "true",
        "ip": "len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 OR right(p, 3)::INT > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": mod97,
        "ssn": f"NOT regexp_matches(s, '^(000|666|9)|-00-|-0000$') AND {near('ssn')}",
    }
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(
            f"""SELECT doc_id, '{kind}' AS kind, {rank} AS r, start, start + length(s) AS stop FROM (
  SELECT doc_id, s, b, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, found, gaps, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS s, unnest(gaps[1:len(found)]) AS b
    FROM (SELECT doc_id, regexp_extract_all(t, '{plain[kind]}') AS found, string_split_regex(t, '{plain[kind]}') AS gaps FROM d)))
  WHERE {tests[kind]}"""
        )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (r = {r}) AS n_{k}" for r, k in enumerate(BASE))},
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, r) FILTER (r < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, r) AS spans FROM p GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


ORACLE = _oracle()
