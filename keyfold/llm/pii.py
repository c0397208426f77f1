"""Personal data: patterns propose spans, checksums confirm them, context decides.

Only Spark expressions run here. For each kind the text between matches and the
matches are taken side by side (`split`, `regexp_extract_all`); running lengths give
positions in code points, end exclusive. Matches are leftmost and do not overlap; one
that fails its validator is dropped and the text inside it not tried again.

Base kinds: email; ip (parts up to 255); card (13 to 19 digits, Luhn); phone (9 to 15 digits). The method
adds iban (length by country, mod-97), dni (Spanish, letter mod-23), nir (French, key mod-97),
taxid (German, 11 digits, ISO 7064), ssn (US, no checksum) and secret (long mixed runs, such as
keys and tokens).

The score of a span has the points of its kind (START), CHECKED for a confirmed checksum or the form of a
known issuer's key, and NEAR if a word for the kind stands in the CONTEXT characters before the span (since the match
before it). A base span stays whatever its score; an added one is kept from LEAST points up: a
checksum of two digits or a letter is enough, one of a single digit needs a word too, and
an ssn or a secret without a known form needs a word.

The patterns start where a run of their characters starts (or where the last match
ended) and do not give characters back where that cannot help: they find what the
plain patterns find, but in linear time on any text and without deep recursion.

Defined results: a null text is empty; an empty or very long text is scanned whole; repeated rows each
get a row; null ids keep a row; other columns are left alone (one named `spans` is replaced); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTEXT = 40
#: Lengths of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(rf"(?:{'|'.join(held.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, held in IBAN_LENGTHS.items())
#: Plain pattern of each kind, in the order of the result. Those of EDGED stand between other characters than letters, digits and `_`.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": f"(?:{_IBAN})",
    "dni": r"[0-9XYZ][0-9]{7}-?[A-Z]",
    "nir": r"[12](?:\x20?[0-9]){14}",
    "taxid": r"[1-9][0-9]{10}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9_-]{20,}",
}
EDGED = ("iban", "dni", "nir", "taxid", "ssn")
#: The same as they run here.
PATTERNS = {k: rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])" for k, p in PLAIN.items() if k in EDGED} | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PLAIN["phone"],
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What a text must hold for a pattern to be tried: a part of every match that is found faster.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
SIGNS = {
    "card": "[0-9]{2}|[0-9][ -][0-9]", "iban": "[A-Z]{2}[0-9]{2}", "dni": "[0-9]{7}", "nir": r"[12](?:\x20?[0-9]){14}", "taxid": "[0-9]{11}", "ssn": "-[0-9]{2}-", "secret": PATTERNS["secret"],
}
#: Words that speak for a kind.
WORDS = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|host|server|address",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "dni": r"\bdni\b|\bnie\b|\bnif\b|documento|identidad",
    "nir": r"\bnir\b|secu|social|assurance",
    "taxid": r"steuer|\btax|\bidnr",
    "ssn": r"\bssn\b|social",
    "secret": "token|secret|passw|pwd|key|credential|bearer|auth",
}
BASE = ("email", "ip", "card", "phone")
#: Points of a kind, of a confirmed checksum, of a word nearby; the least of an added span.
START = {"email": 60, "ip": 50, "card": 50, "phone": 50, "iban": 50, "dni": 35, "nir": 40, "taxid": 25, "ssn": 45, "secret": 45}
CHECKED, NEAR, LEAST = 30, 20, 60
#: Control letters by remainder; how keys of known issuers begin.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ISSUED = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{16}|xox[abeprs]-[A-Za-z0-9]|[sr]k_live_[A-Za-z0-9]{12}|glpat-[A-Za-z0-9_-]{12}|npm_[A-Za-z0-9]{16})"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    number = digits(c)

    def weigh(d: Column, i: Column) -> Column:
        d = d.try_cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.transform(F.split(F.reverse(number), ""), weigh), F.lit(0), lambda a, d: a + d)
    return F.length(number).between(13, 19) & (F.when(F.length(number).between(13, 19), total % 10) == 0)


def mod97(c: Column) -> Column:
    """Whether an IBAN leaves 1."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, x: Column) -> Column:
        d = x.try_cast("int")
        return F.when(d.isNotNull(), (acc * 10 + d) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def dni(c: Column) -> Column:
    """Whether the letter is that of the number; X, Y and Z in front stand for 0, 1 and 2."""
    number = F.translate(F.substring(c, 1, 8), "XYZ", "012").try_cast("int")
    return F.substring(F.lit(DNI_LETTERS), number % 23 + 1, F.lit(1)) == F.right(c, F.lit(1))


def nir(c: Column) -> Column:
    """Whether the last two of 15 digits are 97 less the remainder of the others."""
    number = F.replace(c, F.lit(" "), F.lit(""))
    return 97 - F.substring(number, 1, 13).try_cast("bigint") % 97 == F.substring(number, 14, 2).try_cast("bigint")


def taxid(c: Column) -> Column:
    """Whether the eleventh digit is the control digit of the others (ISO 7064, mod 11, 10)."""

    def step(p: Column, d: Column) -> Column:
        rest = (d.try_cast("int") + p) % 10
        return 2 * F.when(rest == 0, 10).otherwise(rest) % 11

    p = F.aggregate(F.split(F.substring(c, 1, 10), ""), F.lit(10), step)
    return (11 - p) % 10 == F.right(c, F.lit(1)).try_cast("int")


def confirmed(kind: str, match: Column) -> tuple[Column, Column]:
    """Whether a match may be one of its kind, and whether a checksum or a known form says that it is."""
    no, yes = F.lit(False), F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"), no
    if kind == "phone":
        return F.length(digits(match)).between(9, 15), no
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$"), no
    if kind == "secret":
        mixed = match.rlike("[0-9][^0-9]*[0-9]") & match.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]")
        varied = F.size(F.array_distinct(F.split(F.substring(match, 1, 400), ""))) >= 8
        return mixed & varied | match.rlike(ISSUED), match.rlike(ISSUED)
    checks = {"card": luhn, "iban": mod97, "dni": dni, "nir": nir, "taxid": taxid}
    return (checks[kind](match), yes) if kind in checks else (yes, no)


def spans_of(kind: str, text: Column) -> Column:
    """The spans of a kind, in order."""
    pattern = F.lit(PATTERNS[kind])
    pairs = F.zip_with(
        F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
    )

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["match"])
        near = F.translate(F.right(p["gap"], F.lit(CONTEXT)), UPPER, LOWER).rlike(WORDS[kind])
        good, checked = confirmed(kind, p["match"])
        points = F.lit(START[kind]) + F.when(checked, CHECKED).otherwise(0) + F.when(near, NEAR).otherwise(0)
        span = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), (points / 100).alias("score")))
        good = p["match"].isNotNull() & good
        if kind not in BASE:
            good &= points >= LEAST
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(SIGNS[kind])
    return F.when(hint, F.aggregate(pairs, start, step, lambda a: a["spans"])).otherwise(F.array().cast(SPAN))


def find(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of documents with a column `spans`, SPAN, ordered by kind and start."""
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumn("spans", F.concat(*(spans_of(kind, body) for kind in PLAIN)))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span that does not overlap an earlier one replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_pii: personal data in every whole text of documents."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")

    def count(*kinds: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("secret").alias("n_secret"),
        count("iban", "dni", "nir", "taxid", "ssn").alias("n_id"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def _oracle() -> str:
    plain = {k: rf"\b{p}\b" if k in EDGED else p for k, p in PLAIN.items()}
    digits_ = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_ = f"list_sum(list_transform(string_split(reverse({digits_}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    rest = f"list_reduce(list_transform(string_split({bare}[5:] || {bare}[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), lambda a, d: (CASE WHEN d > 9 THEN a * 100 ELSE a * 10 END + d) % 97, 0)"
    control = "list_reduce(list_transform(string_split(m[:10], ''), lambda c: c::INT), lambda p, d: 2 * CASE WHEN (d + p) % 10 = 0 THEN 10 ELSE (d + p) % 10 END % 11, 10)"
    valid = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255",
        "card": f"length({digits_}) BETWEEN 13 AND 19 AND {luhn_}",
        "phone": f"length({digits_}) BETWEEN 9 AND 15",
        "iban": f"{rest} = 1",
        "dni": f"substr('{DNI_LETTERS}', translate(m[:8], 'XYZ', '012')::INT % 23 + 1, 1) = right(m, 1)",
        "nir": f"97 - {bare}[:13]::BIGINT % 97 = {bare}[14:]::BIGINT",
        "taxid": f"(11 - {control}) % 10 = right(m, 1)::INT",
        "ssn": "m[:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:] <> '0000'",
        "secret": f"regexp_matches(m, '{ISSUED}') OR length(regexp_replace(m, '[^0-9]', '', 'g')) > 1 AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) > 1 AND len(list_distinct(string_split(m[:400], ''))) >= 8",
    }
    parts = []
    for n, (kind, p) in enumerate(plain.items()):
        checked = "true" if kind in ("card", "iban", "dni", "nir", "taxid") else f"regexp_matches(m, '{ISSUED}')" if kind == "secret" else "false"
        points = f"{START[kind]} + CASE WHEN {checked} THEN {CHECKED} ELSE 0 END + CASE WHEN regexp_matches(translate(right(g, {CONTEXT}), '{UPPER}', '{LOWER}'), '{WORDS[kind]}') THEN {NEAR} ELSE 0 END"
        parts.append(f"""
  SELECT * FROM (SELECT doc_id, {n} AS o, '{kind}' AS kind, s, s + length(m) AS e, {points} AS points FROM (
    SELECT doc_id, ms[i] AS m, gs[i] AS g, (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d)))
  WHERE {valid[kind]}){"" if kind in BASE else f" WHERE points >= {LEAST}"}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*BASE, 'secret'))},
  count(*) FILTER (kind IN ('iban', 'dni', 'nir', 'taxid', 'ssn')) AS n_id, count(*) AS n_spans, max(points) / 100 AS top_score,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4) AS base FROM s GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in (*BASE, 'secret'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_id, 0)::BIGINT AS n_id, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(top_score, 0)::DOUBLE AS top_score
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
