"""Secret scans with Spark column expressions only.

Base kinds are regular expressions, found leftmost and without overlap. Positions come from the
pieces between the matches: a match starts where the pieces and matches before it end, in code
points. The method adds spans of kind ``entropy``: a window of ``WINDOW`` characters slides over
each candidate string, counts per character are kept incrementally (one character enters, one
leaves), and the span runs from the first to the last window whose Shannon entropy reaches the
limit of the candidate's character class. Candidates on the allow-list add nothing. With
``beside``, as the queries have it, base spans are cut out of a candidate and each piece that is
left is a candidate of its own; without it a candidate that overlaps a base span adds nothing.

Null text counts as empty; null ``doc_id`` stays null; repeated rows each give a row; an empty
table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored (``redact``
keeps them). Very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, texts

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of 24 or more is met at its start
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, the narrowest first, and the entropy in bits that a window must reach.
CLASSES = ((r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Z0-9]+$", 3.4), (r"^[a-z0-9]+$", 3.4), (r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: Letters in the case of words: one letter, or runs of two and more of one case after one
#: another, with a capital before a small run or not, as in camel case. Possessive throughout,
#: so that no string is tried in many ways.
WORDLIKE = r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)++|[A-Za-z])(?![A-Za-z])"
#: Candidates that are no secrets: no letter; identifiers and paths of whole words and numbers;
#: UUIDs.
ALLOW = (
    r"^[^A-Za-z]*$",
    rf"^[/_=+-]*+(?>{WORDLIKE}|[0-9]++)(?:[/_=+-]++(?>{WORDLIKE}|[0-9]++))*+[/_=+-]*+$",
    rf"^{WORDLIKE}[0-9]{{1,4}}$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
SPAN = "array<struct<start:int,kind:int,stop:int,hit:string>>"


def _in_turn(items: Column, start: Column, step, out_type: str) -> Column:
    """What ``step(at, item) -> (at, one)`` makes of the items, one after another, as an array.
    Items go in lots of 64, so that the growing array is copied for each lot only."""

    def one(done: Column, item: Column) -> Column:
        at, found = step(done["at"], item)
        return F.struct(at.alias("at"), F.concat(done["out"], F.array(found)).alias("out"))

    def lot(done: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(done["at"].alias("at"), F.array().cast(out_type).alias("out")), one)
        return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(done["out"], x["out"]).alias("out")))

    def run(all_items: Column) -> Column:
        lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / 64).cast("int")), lambda i: F.slice(all_items, i * 64 + 1, 64))
        return F.aggregate(lots, F.struct(start.alias("at"), F.array().cast(out_type).alias("out")), lot)

    return let(items, run)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches as ``(start, kind, stop, hit)``, in code points, the end exclusive."""

    def place(hits: Column) -> Column:
        between = F.split(text, pattern, -1)
        pairs = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))

        def step(at: Column, p: Column) -> tuple[Column, Column]:
            start = at + p["gap"]
            stop = start + F.char_length(p["hit"])
            return stop, F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), p["hit"].alias("hit"))

        return F.when(F.size(hits) > 0, _in_turn(pairs, F.lit(0), step, SPAN)["out"]).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _weight(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def entropy_hull(candidate: Column, limit: Column, window: int = WINDOW) -> Column:
    """``(from, to)`` of the windows of an ASCII string whose entropy reaches the limit; from is
    -1 if none does. With S the sum of n log2 n over the counts, entropy is log2 w - S / w; as a
    window moves, S changes by the counts of the two characters that enter and leave, which are
    looked up in the window itself. So the work is a window for each character."""

    def scan(held: Column) -> Column:
        code = held["code"]
        times = lambda x, low, n: F.size(F.filter(F.slice(code, low + 1, n), lambda c: c == x))

        def step(state: Column, i: Column) -> Column:
            enter, leave = code[i], code[F.greatest(i - window, F.lit(0))]
            had = times(enter, F.greatest(i - window, F.lit(0)), F.least(i, F.lit(window)))
            # The entering character is counted before the leaving one is taken off.
            left = times(leave, i - window, F.lit(window + 1))
            off = F.when(i >= window, let(left, lambda n: _weight(n - 1) - _weight(n))).otherwise(0.0)
            s = state["s"] + let(had, lambda n: _weight(n + 1) - _weight(n)) + off

            def judge(s: Column) -> Column:
                high = (i >= window - 1) & (F.log2(F.lit(float(window))) - s / window >= held["limit"] - 1e-9)
                first = F.when(high & (state["from"] < 0), i - window + 1).otherwise(state["from"])
                return F.struct(s.alias("s"), first.alias("from"), F.when(high, i + 1).otherwise(state["to"]).alias("to"))

            return let(s, judge)

        start = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("from"), F.lit(-1).alias("to"))
        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to")))

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c))
    # The limit is found once for a candidate, not for each of its characters.
    return let(F.struct(codes.alias("code"), limit.alias("limit")), scan)


def _limit(hit: Column) -> Column:
    out = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        out = F.when(hit.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def _pieces(found: Column, base: Column, window: int) -> Column:
    """What base spans (in order) leave of each candidate, pieces of a window and more."""

    def piece(c: Column, start: Column, stop: Column) -> Column:
        return F.struct(start.alias("start"), c["kind"].alias("kind"), stop.alias("stop"), F.substring(c["hit"], start - c["start"] + 1, stop - start).alias("hit"))

    def step(c: Column):
        def take(done: Column, b: Column) -> Column:
            before = F.greatest(F.least(b["start"], c["stop"]), done["at"])
            return F.struct(F.greatest(done["at"], b["stop"]).alias("at"), F.concat(done["out"], F.array(piece(c, done["at"], before))).alias("out"))

        return take

    def cut(c: Column) -> Column:
        near = F.filter(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
        start = F.struct(c["start"].alias("at"), F.array().cast(SPAN).alias("out"))
        rest = F.aggregate(near, start, step(c), lambda d: F.concat(d["out"], F.array(piece(c, d["at"], F.greatest(d["at"], c["stop"])))))
        return F.when(F.size(near) > 0, rest).otherwise(F.array(c))

    return F.filter(F.flatten(F.transform(found, cut)), lambda c: c["stop"] - c["start"] >= window)


def _entropy(found: Column, base: Column, allow: tuple[str, ...], window: int, beside: bool) -> Column:
    if beside:
        found = _pieces(found, base, window)

    def open_to(c: Column) -> Column:
        clear = F.lit(True) if beside else ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
        for pattern in allow:
            clear = clear & ~c["hit"].rlike(pattern)
        return clear

    def span(c: Column) -> Column:
        return let(
            entropy_hull(c["hit"], _limit(c["hit"]), window),
            lambda h: F.struct((c["start"] + h["from"]).alias("start"), c["kind"].alias("kind"), (c["start"] + h["to"]).alias("stop"), F.when(h["from"] >= 0, c["hit"]).alias("hit")),
        )

    return F.filter(F.transform(F.filter(found, open_to), span), lambda s: s["hit"].isNotNull())


def find(docs: DataFrame, *more: str, allow: tuple[str, ...] = ALLOW, window: int = WINDOW, beside: bool = False) -> DataFrame:
    """``doc_id, text``, columns named besides, ``base`` and ``added``: arrays of
    ``(start, kind, stop, hit)`` in order, ``kind`` an index of ``KINDS``."""
    text = F.col("text")
    base = F.array_sort(
        F.concat(
            F.filter(_spans(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 6),
            F.filter(_spans(text, ACCESS, 1), lambda s: s["stop"] - s["start"] >= 20),
            _spans(text, HEX, 2),
        )
    )
    out = texts(docs, *more).select("*", base.alias("base"), _spans(text, CANDIDATE, 3).alias("candidates"))
    added = F.when(F.size("candidates") > 0, _entropy(F.col("candidates"), F.col("base"), allow, window, beside)).otherwise(F.array().cast(SPAN))
    return out.select("doc_id", "text", *more, "base", added.alias("added"))


def _told(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["stop"])), ",")


def report(docs: DataFrame, beside: bool = False) -> DataFrame:
    """Per document the counts of the base kinds, the digest of the base spans, all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find(docs, beside=beside).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", beside: bool = False) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping spans by one; ``n_chars``, if
    it is there, follows. Rows without spans keep their text, null included."""
    columns = docs.columns
    held = docs.select(F.struct(*columns).alias("__row"), "doc_id", "text")
    found = find(held, "__row", beside=beside).withColumn("__all", F.array_sort(F.concat("base", "added")))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.when(s["start"] >= at, F.concat(F.substring(F.col("text"), at + 1, s["start"] - at), F.lit(mark))).otherwise("")
        return F.greatest(at, s["stop"]), piece

    clean = let(_in_turn(F.col("__all"), F.lit(0), step, "array<string>"), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(F.col("text"), d["at"] + 1, F.char_length("text"))))
    found = found.withColumn("__text", F.when(F.size("__all") > 0, clean).otherwise(F.col("__row.text")))
    new = {"text": F.col("__text")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.size("__all") > 0, F.char_length("__text")).otherwise(F.col("__row.n_chars")).cast(kind)
    return found.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in columns])
