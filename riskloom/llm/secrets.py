"""Secret scan: known forms, and high-entropy stretches found by a sliding window. Column expressions only.

Where a pattern matches is read off by splitting the text at its matches: the lengths of what lies between
and of the matches add up to the places. Candidate strings for the window are long runs of key characters.
Their Shannon entropy over WINDOW characters follows from the sum of c * log2(c) over the character counts
c, which changes at two counts when the window moves on by one. What the threshold is depends on the
characters a candidate is made of. What the allow-list matches splits a candidate, and what is left of it is
scanned: a word of the list takes the letters and digits around it along, up to the next mark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base forms, in the order kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 6), "access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]{24,}", 24)}
KINDS = [*BASE, "entropy"]

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"
#: Class of a candidate (its pattern) -> bits at which a window counts; the first class that fits holds.
CLASSES = {
    "^[0-9]+$": 9.0,  # digits alone are numbers, not keys
    "^[0-9A-Fa-f]+$": 3.0,
    "^[A-Za-z]+$": 4.1,
    "^(?=.*[0-9])(?=.*[A-Za-z])": 3.7,
    "": 4.0,
}
#: Examples, placeholders, counted-up or repeated characters, and lower-case words joined by marks.
ALLOWED = r"(?i)example|placeholder|dummy|your[_-]|x{6,}|0{8,}|(.)\1{7,}|abcdefgh|01234567|12345678"
ALLOWED_PARTS = r"(?i)[a-z0-9]*(?:example|placeholder|dummy|your[_-])[a-z0-9]*|x{6,}|0{8,}|(.)\1{7,}|abcdefgh|01234567|12345678"
ALLOWED_WORDS = r"^[a-z]+(?:[-_/=+][a-z]+)*[-_/=+]*$|^[-_=+/]+$"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, found: Column, pattern: str) -> Column:
    """[(start, end, match)] in code points for the matches `found` of `pattern`."""
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    walked = F.aggregate(
        F.arrays_zip(found.alias("match"), F.slice(between, 1, F.size(found)).alias("gap")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["match"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("match")
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(none)


def window_hits(word: Column, bits: Column) -> Column:
    """(first, last): starts of the first and the last window of the word at `bits` or more; null if none."""
    step = F.lit(WINDOW)
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    product = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(0.0)
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def move(acc: Column, i: Column, codes: Column) -> Column:
        new = F.get(codes, i)
        old = F.when(i >= step, F.get(codes, i - step)).otherwise(-1)
        n, m = F.get(acc["counts"], new), F.when(old >= 0, F.get(acc["counts"], F.greatest(old, F.lit(0)))).otherwise(0)
        changed = F.when(
            new == old, F.lit(0.0)
        ).otherwise(product(n + 1) - product(n) + F.when(old >= 0, product(m - 1) - product(m)).otherwise(0.0))
        total = acc["sum"] + changed
        hit = (i >= step - 1) & (F.lit(math.log2(WINDOW)) - total / step >= bits - 1e-9)
        counts = F.when(new == old, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int"))
        )
        at = i - step + 1
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(hit & acc["first"].isNull(), at).otherwise(acc["first"]).alias("first"),
            F.when(hit, at).otherwise(acc["last"]).alias("last"),
        )

    # the codes are bound once, as the single element of an array, and not computed for each step
    walked = F.transform(
        F.array(codes),
        lambda cs: F.aggregate(
            F.sequence(F.lit(0), F.size(cs) - 1), start, lambda acc, i: move(acc, i, cs), lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
        ),
    )
    return walked[0]


def left_over(candidate: Column) -> Column:
    """[(start, end, match)] of what the allow-list leaves of a candidate; all of it where nothing matches."""
    word = candidate["match"]
    allowed = F.regexp_extract_all(word, F.lit(ALLOWED_PARTS), F.lit(0))
    pieces = F.split(word, ALLOWED_PARTS, -1)
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    cut = F.aggregate(
        F.arrays_zip(pieces.alias("piece"), allowed.alias("gone")),
        F.struct(candidate["start"].alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"]) + F.coalesce(F.length(x["gone"]), F.lit(0))).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["piece"])).alias("end"), x["piece"].alias("match"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(word.rlike(ALLOWED), cut).otherwise(F.array(candidate))


def entropy_spans(text: Column, found: Column) -> Column:
    """[(start, end)] of the high-entropy stretches of the candidates `found`."""

    def bits(word: Column) -> Column:
        out = F.lit(9.0)
        for pattern, least in reversed(CLASSES.items()):
            out = F.when(word.rlike(pattern), F.lit(least)).otherwise(out)
        return out

    whole = F.filter(placed(text, found, CANDIDATE), lambda x: ~x["match"].rlike(ALLOWED_WORDS))
    kept = F.filter(F.flatten(F.transform(whole, left_over)), lambda x: (F.length(x["match"]) >= WINDOW) & ~x["match"].rlike(ALLOWED_WORDS))
    hits = F.transform(kept, lambda x: F.struct(x["start"].alias("at"), window_hits(x["match"], bits(x["match"])).alias("hit")))
    return F.transform(
        F.filter(hits, lambda x: x["hit"]["first"].isNotNull()),
        lambda x: F.struct((x["at"] + x["hit"]["first"]).alias("start"), (x["at"] + x["hit"]["last"] + WINDOW).alias("end")),
    )


def base_spans(text: Column, kind: str, n: int) -> Column:
    """[(start, kind, end)] of one base form, its matches in column _m<n>."""
    pattern, least = BASE[kind]
    long = lambda m: F.length(F.regexp_extract(m, pattern, 2) if kind == "assign" else m) >= least
    spans = F.filter(placed(text, F.col(f"_m{n}"), pattern), lambda x: long(x["match"]))
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end")))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of documents with `secrets`: [(start, kind, end)], kind an index into KINDS, by start and kind.

    Code points, end exclusive. A null text has none, like an empty one; a match without the length its
    kind asks for is dropped. All rows and columns stay.
    """
    spare = {f"_m{n}": f for n, f in enumerate([ASSIGN, *[BASE[k][0] for k in ("access", "hex")], CANDIDATE])}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    scanned = docs.withColumns({c: matches(body, p) for c, p in spare.items()})
    parts = [base_spans(body, kind, n) for n, kind in enumerate(BASE)]
    spans = F.when(F.size("_m3") > 0, entropy_spans(body, F.col("_m3")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts.append(F.coalesce(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))), empty))
    some = F.size("_m0") + F.size("_m1") + F.size("_m2") + F.size("_m3") > 0
    return scanned.withColumn("secrets", F.when(some, F.array_sort(F.concat(*parts))).otherwise(empty)).drop(*spare)


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row of documents.

    Null and empty texts have no spans; base_sha256 is then that of the empty string. Repeated rows stay;
    an empty table gives no rows; extra columns are ignored.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.filter("secrets", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of documents; every secret in the text replaced by `mark`, n_chars as it then is."""
    found = find_secrets(docs)
    cut = F.aggregate(
        "secrets",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(
                x["start"] >= acc["at"],
                F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit(mark)),
            ).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1)),
    )
    cleaned = found.withColumn("text", F.when(F.size("secrets") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)
