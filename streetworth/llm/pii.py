"""Personal data, with DataFrame functions only.

Regular expressions propose spans; validators confirm them (ranges of address parts, Luhn's sum for cards, digit counts for phones, the remainder 97
for IBANs); context words just before a span raise the score of kinds whose shape alone says little. Positions come from the gaps between matches:
``split`` gives the gaps, ``regexp_extract_all`` the matches, and their lengths add up to code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetworth.llm._common import bundled, restored

#: Kinds in the order in which spans of one start are listed. The first four are always kept once valid; the others need the score.
KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")
BASE = KINDS[:4]

# Possessive quantifiers and the looks behind only save backtracking: a leftmost match begins where its run of characters begins (or the last match ended).
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone_local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A cheap test that every text with a match passes.
_GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "phone_local": r"[0-9]{3}[\x20.-][0-9]{4}"}
_SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.7, "phone_local": 0.4}
_WORDS = {
    "email": "mail|contact|write|courriel|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "phone_local": "phone|tel|call|mobile|fax",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum is divisible by 10: from the right, every second digit is doubled and its digits added."""

    def value(at: Column, place: Column) -> Column:
        twice = at * (F.lit(1) + place % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    turned = F.split(F.reverse(digits), "(?!^)(?!$)")
    values = F.transform(turned, lambda c, i: value(F.expr("cast(1 as int)") * c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod97(x: Column) -> Column:
    """The first four characters moved to the end, letters read as 10 to 35, the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(x, r"\x20", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "(?!^)(?!$)")
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(x))
    if kind == "phone":
        return n.between(10, 15)
    return _mod97(x) if kind == "iban" else F.lit(True)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"
#: Code points in front of a match in which context words are looked for.
_NEAR = 40


def _with_running(df: DataFrame, name: str, values: Column, most: bool = False) -> DataFrame:
    """df with `name`: the running sums of an array of whole numbers that are not negative, or with `most` the running maxima.

    An array grows by being copied; so values are added up in blocks of about the square root of their number, and the blocks' ends are carried on.
    """
    join = (lambda a, b: F.greatest(a, b)) if most else (lambda a, b: a + b)
    last = lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0))
    width = F.greatest(F.ceil(F.sqrt(F.size("_values"))).cast("int"), F.lit(1))
    none = F.array().cast("array<int>")
    df = df.withColumn("_values", values).withColumn("_width", width)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("_values") - 1) / F.col("_width")).cast("int"), F.lit(0))), lambda b: F.slice("_values", b * F.col("_width") + 1, F.col("_width")))
    df = df.withColumn("_blocks", F.transform(blocks, lambda block: F.aggregate(block, none, lambda acc, x: F.array_append(acc, join(last(acc), x)))))
    df = df.withColumn("_before", F.aggregate("_blocks", F.array(F.lit(0)), lambda acc, block: F.array_append(acc, join(last(acc), last(block)))))
    # Arrays meet by zip_with: a column that a lambda reads by place may be computed anew for each element.
    out = F.flatten(F.array_compact(F.zip_with("_blocks", "_before", lambda block, b: F.transform(block, lambda x: join(x, b)))))
    return df.withColumn(name, out).drop("_values", "_width", "_blocks", "_before")


def _with_found(df: DataFrame, kind: str) -> DataFrame:
    """df with a column named as the kind: array<struct<start, rank, end, kind, score>> of the valid leftmost matches in `whole`; positions in code points, end exclusive."""
    text, pattern = F.col("whole"), F.lit(_PATTERNS[kind])
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    df = df.withColumn("_pieces", F.when(text.rlike(_GUARDS[kind]), pieces).otherwise(F.expr("cast(array() as array<struct<gap:string,match:string>>)")))
    length = lambda x: F.coalesce(F.length(x), F.lit(0))
    df = _with_running(df, "_ends", F.transform("_pieces", lambda x: length(x["gap"]) + length(x["match"])))
    # A match has five characters or more, so that eight pieces and the gap hold what stands close before a match.
    df = df.withColumn("_tails", F.transform("_pieces", lambda x: F.right(F.concat(F.right(x["gap"], F.lit(_NEAR)), F.coalesce(x["match"], F.lit(""))), F.lit(_NEAR))))

    def span(x: Column, i: Column) -> Column:
        end = F.get("_ends", i)
        # One by one: a slice reads the whole array each time.
        before = [F.coalesce(F.get("_tails", F.greatest(i - k, F.lit(-1))), F.lit("")) for k in range(8, 0, -1)]
        before = F.right(F.concat(*before, F.right(x["gap"], F.lit(_NEAR))), F.lit(_NEAR))
        near = F.lower(before).rlike(rf"(?:^|[^\p{{L}}])(?:{_WORDS[kind]})")
        score = F.least(F.lit(1.0), F.lit(_SCORES[kind]) + F.when(near, 0.2).otherwise(0.0))
        whole = F.struct((end - F.length(x["match"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        return F.when(x["match"].isNotNull() & _valid(kind, x["match"]), whole)

    return df.withColumn(kind, F.array_compact(F.transform("_pieces", span)).cast(f"array<{_SPAN}>")).drop("_pieces", "_ends", "_tails")


def find_pii(docs: DataFrame, least_score: float = 0.6) -> DataFrame:
    """docs with `spans`: array<struct<start, end, rank, kind, score>> sorted by start and kind, over whole texts; a null text counts as empty.

    Kinds that the shape alone gives away are kept whenever valid; IBANs and local phone numbers need a score of least_score and must not overlap the
    former. Other columns stay, whatever their names (one named `spans` is replaced); repeated rows give repeated results; an empty table gives no rows.
    No shuffle. The work is in proportion to a text, and for n matches to n and, with a small factor, to n ** 1.5 (see _with_running).
    """
    columns = [c for c in docs.columns if c.lower() != "spans"]
    work = bundled(docs, "text").withColumn("whole", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        work = _with_found(work, kind)
    work = work.withColumn("base", F.concat(*BASE))
    more = F.filter(F.concat(*[k for k in KINDS if k not in BASE]), lambda s: s["score"] >= least_score)
    # One of the other kinds meets no base span if none of those that start before its end reaches beyond its start.
    base = F.transform("base", lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("order"), s["end"].alias("reach"), F.lit(None).cast(_SPAN).alias("span")))
    asked = F.transform(more, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("order"), F.lit(0).alias("reach"), s.alias("span")))
    work = _with_running(work.withColumn("points", F.array_sort(F.concat(base, asked))), "reach", F.transform("points", lambda p: p["reach"]), most=True)
    free = F.array_compact(F.zip_with("points", "reach", lambda p, most: F.when(p["span"].isNotNull() & (most <= p["span"]["start"]), p["span"])))
    # Structs sort by their fields in order: start, then rank.
    sorted_ = F.array_sort(F.concat("base", free))
    spans = F.transform(sorted_, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "rank", "kind", "score"))))
    return work.select(*restored(work, columns, "text"), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """Replace the spans of find_pii() in `text` by [KIND]; overlapping spans become one mark. Null texts stay null; rows without spans are unchanged. Other columns stay, but `spans` goes."""
    columns = [c for c in found.columns if c.lower() != "spans"]
    work = bundled(found, "text", "spans").withColumn("some", F.size("spans") > 0)
    # To reach a place in a text costs as much as the text before it is long, so it is cut into blocks once.
    work = work.withColumn("blocks", F.when(F.col("some"), F.regexp_extract_all("text", F.lit("(?s).{1,1000}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    work = work.withColumn("n", F.when(F.col("some"), F.length("text")).otherwise(F.lit(0)))
    work = _with_running(work, "upto", F.transform("spans", lambda s: s["end"]), most=True)

    def between(a: Column, b: Column) -> Column:
        """The text from place a to place b, a <= b."""
        i, j = F.floor(a / 1000).cast("int"), F.floor(b / 1000).cast("int")
        part = lambda k: F.coalesce(F.get("blocks", k), F.lit(""))
        middle = F.when(j > i + 1, F.array_join(F.slice("blocks", i + 2, j - i - 1), "")).otherwise("")
        across = F.concat(part(i).substr(a - i * 1000 + 1, F.lit(1000)), middle, part(j).substr(F.lit(1), b - j * 1000))
        return F.when(i == j, part(i).substr(a - i * 1000 + 1, b - a)).otherwise(across)

    def piece(s: Column, i: Column) -> Column:
        at = F.when(i == 0, 0).otherwise(F.get("upto", i - 1))
        return F.when(s["start"] >= at, F.concat(between(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    rest = between(F.get("upto", F.size("upto") - 1), F.col("n"))
    work = work.withColumn("whole", F.concat(F.array_join(F.transform("spans", piece), ""), rest))
    work = work.withColumn("text", F.when(F.col("some"), F.col("whole")).otherwise(F.col("text")))
    return work.select(*restored(work, columns, "text"))
