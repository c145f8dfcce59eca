"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Every kind has a pattern, a test of the proposed text (Luhn for cards, mod-97 for IBANs, ranges and shapes for the others), a prior score
and words that raise or lower it if they stand in the 40 characters before the span (not reaching into the kind's span before it).
E-mail addresses, IP addresses, cards and international phone numbers stay whatever their score; the other kinds stay from `threshold` on: an
IBAN by its checksum alone, a social security number or a phone number without country code only with a word that says so.

DataFrame functions only, one pass over the texts and no shuffle. Places come from the lengths of the parts between proposals. A pattern's
first look-behinds only keep it from trying every character of a long run again; they propose what the plain forms in `PLAIN` do.

Defined cases: null text counts as empty; a proposal that fails its test is dropped and not tried again in part; spans of different kinds may
overlap and are all kept, in order of start, then kind as listed in `KINDS`; places are code points; very long texts are searched whole; equal rows
get equal results; an empty table gives no rows; other columns are kept, and columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Lengths of IBANs by country (fixed values of the public registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + ")"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_SHAPE = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
SSN_SHAPE, LOCAL_SHAPE = "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"
NEAR, THRESHOLD, RAISE, LOWER = 40, 0.6, 0.4, 0.3


@dataclass(frozen=True)
class Kind:
    pattern: str
    prior: float
    raising: str
    lowering: str
    confirm: Callable[[Column], Column]
    always: bool = False


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's test."""

    def weighed(digit: Column, place: Column) -> Column:
        d = digit.cast("int")
        return F.when(place % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    backwards = F.regexp_extract_all(F.reverse(value), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(F.transform(backwards, weighed), F.lit(0), lambda total, x: total + x) % 10 == 0


def mod_97(value: Column) -> Column:
    """Whether an IBAN's remainder modulo 97 is 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.regexp_extract_all(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), F.lit("."), F.lit(0))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


#: In the order in which spans that start together are listed.
KINDS: dict[str, Kind] = {
    "email": Kind(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "e-?mail|contact", "", lambda v: F.lit(True), True),
    "ip": Kind(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|addr|host|server", "version|release|section", lambda v: v.rlike(IP_SHAPE), True),
    "card": Kind(r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", 0.8, "card|visa|credit|payment", "order|isbn|serial", luhn, True),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "tel|phone|mobile|call|fax", "", lambda v: F.char_length(_digits(v)).between(10, 15), True),
    "iban": Kind(IBAN, 0.8, "iban|account|bank", "", mod_97),
    "ssn": Kind(r"(?<![0-9])[0-9]++(?:-[0-9]++)++", 0.3, "ssn|social security", "order|part", lambda v: v.rlike(SSN_SHAPE) & ~v.rlike("^(?:000|666|9)|-00-|-0000$")),
    "local_phone": Kind(r"(?<![0-9])[0-9]++(?:[.-][0-9]++)++", 0.3, "tel|phone|mobile|call|fax", "order|part", lambda v: v.rlike(LOCAL_SHAPE)),
}
#: The same proposals without look-behinds and possessive repeats, for engines that have neither.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN, "ssn": "[0-9]+(?:-[0-9]+)+", "local_phone": "[0-9]+(?:[.-][0-9]+)+",
}
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,score:double>"


def _spans(text: Column, name: str, rank: int, kind: Kind, threshold: float) -> Column:
    """array of _SPAN: the spans of one kind, in order."""
    none = F.array().cast(f"array<{_SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))
    parts = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))

    def score(gap: Column) -> Column:
        near = F.lower(F.right(gap, F.lit(NEAR)))
        up = F.when(near.rlike(kind.raising), RAISE).otherwise(0.0)
        down = F.when(near.rlike(kind.lowering), LOWER).otherwise(0.0) if kind.lowering else F.lit(0.0)
        return F.round(F.least(F.greatest(F.lit(kind.prior) + up - down, F.lit(0.0)), F.lit(1.0)), 2)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["value"])
        kept = part["value"].isNotNull() & kind.confirm(part["value"])
        if not kind.always:
            kept = kept & (score(part["gap"]) >= threshold)
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(name).alias("kind"), part["value"].alias("value"), score(part["gap"]).alias("score"))
        return F.struct(end.alias("at"), F.when(kept, F.array_append(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.when(text.rlike(kind.pattern), F.aggregate(parts, zero, step, lambda state: state["found"])).otherwise(none)


def find_personal(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with personal, an array of (start, end, kind, value, score) in order."""
    body = F.coalesce(docs[text], F.lit(""))
    by_kind = [_spans(body, name, rank, kind, threshold) for rank, (name, kind) in enumerate(KINDS.items())]
    ordered = F.array_sort(F.concat(*by_kind))
    shown = F.transform(ordered, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "value", "score")]))
    return docs.select(*[docs[c] for c in docs.columns if c != "personal"], shown.alias("personal"))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of find_personal with every span in text replaced by its kind in angle brackets; of overlapping spans the first names all."""
    body = found[text]

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        between = F.substr(body, state["at"] + 1, s["start"] - state["at"])
        said = F.when(apart, F.concat(state["said"], between, F.lit("<"), s["kind"], F.lit(">"))).otherwise(state["said"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), said.alias("said"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("said"))
    covered = F.aggregate("personal", zero, step, lambda state: F.concat(state["said"], F.substr(body, state["at"] + 1)))
    return found.withColumn(text, F.when(F.size("personal") > 0, covered).otherwise(body))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [name for name, kind in KINDS.items() if kind.always]

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*names: str) -> Column:
        return F.filter("personal", lambda s: s["kind"].isin(*names))

    counts = [F.size(of(name)).cast("long").alias(f"n_{name}") for name in base]
    return found.select("doc_id", *counts, F.sha2(listed(of(*base)), 256).alias("base_sha256"), listed(F.col("personal")).alias("spans"))


def _sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_ = f"list_sum(list_transform(regexp_extract_all(reverse(m), '[0-9]'), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN c > '4' THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"
    plain = "replace(m, ' ', '')"
    mod = f"""list_reduce(regexp_extract_all(substr({plain}, 5) || substr({plain}, 1, 4), '.'),
      lambda rest, c: CASE WHEN c <= '9' THEN CAST((CAST(rest AS INTEGER) * 10 + ascii(c) - 48) % 97 AS VARCHAR) ELSE CAST((CAST(rest AS INTEGER) * 100 + ascii(c) - 55) % 97 AS VARCHAR) END, '0') = '1'"""
    near = f"lower(right(g, {NEAR}))"
    confirm = {
        "email": "true", "ip": f"regexp_matches(m, '{IP_SHAPE}')", "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn_}", "phone": f"length({digits}) BETWEEN 10 AND 15", "iban": mod,
        "ssn": f"regexp_matches(m, '{SSN_SHAPE}') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')", "local_phone": f"regexp_matches(m, '{LOCAL_SHAPE}')",
    }
    parts = []
    for rank, (name, kind) in enumerate(KINDS.items()):
        score = f"round(least(greatest({kind.prior} + CASE WHEN regexp_matches({near}, '{kind.raising}') THEN {RAISE} ELSE 0 END" + (f" - CASE WHEN regexp_matches({near}, '{kind.lowering}') THEN {LOWER} ELSE 0 END" if kind.lowering else "") + ", 0.0), 1.0), 2)"
        parts.append(f"""
  SELECT r, '{name}' AS kind, {rank} AS rank, ends - length(m) AS a, ends AS b FROM (
    SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS ends FROM (
      SELECT r, unnest(range(len(p))) AS i, unnest(p) AS g, unnest(f) AS m FROM (SELECT r, regexp_split_to_array(t, '{PLAIN[name]}') AS p, regexp_extract_all(t, '{PLAIN[name]}') AS f FROM d) WHERE len(f) > 0
    ) WHERE m IS NOT NULL
  ) WHERE {confirm[name]}{'' if kind.always else f' AND {score} >= {THRESHOLD}'}""")
    base = ", ".join(f"'{name}'" for name, kind in KINDS.items() if kind.always)
    counts = ", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, kind in KINDS.items() if kind.always)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{name}') AS n_{name}" for name, kind in KINDS.items() if kind.always)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
x AS (
  SELECT r, {sums}, string_agg(said, ',' ORDER BY a, rank) FILTER (WHERE kind IN ({base})) AS own, string_agg(said, ',' ORDER BY a, rank) AS every
  FROM (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS said FROM s) GROUP BY r
)
SELECT d.doc_id, {counts}, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN x ON d.r = x.r
"""


OP13_SQL = _sql()
