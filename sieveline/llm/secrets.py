"""Secret scan in built-in expressions only: patterns, and sliding-window entropy over candidate strings.

Places come from the pieces between matches: the text is split by the same pattern, and running sums over the lengths
of pieces and matches give code-point offsets. Sums run in blocks, so a text with very many matches stays cheap.

Entropy: a candidate is a run of at least ``window`` characters of the base64 alphabets that holds both letters and
digits. Its class is hex or base64. A window slides over it; the count of the entering character rises, that of the
leaving one falls, and the sum of c*log2(c) follows by a table of whole numbers, so the result is exact. Counts are kept
side by side in a few longs, and a candidate is split into characters once, so work is in proportion to its length.
Windows whose entropy reaches the class's threshold, and that hold two letters and two digits, merge into spans.
Candidates that match the allow-list are dropped, and so are spans inside one that a pattern found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import fresh, quoted

#: Kind, pattern, least length, and the group that the length is taken of.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so the least length can stand in the pattern for these two, which is far cheaper.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
ALLOW = (
    r"(?i)example|placeholder|dummy|changeme|your[_-]",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)0123456789|9876543210|abcdefghij",
    r"(?i)^[a-z]++(?:[/_-][a-z]++)*+[/_-]?[0-9]{1,4}$",
)
ALPHABET = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="}
THRESHOLD = {"hex": 2.8, "base64": 3.6}
SCALE, BLOCK = 1 << 20, 256


def running_sums(xs: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array of longs."""
    last = lambda a: F.element_at(a, -1)
    scan = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(xs) - 1), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: scan(F.slice(xs, i + 1, BLOCK)))
    before = scan(F.transform(blocks, last))
    joined = F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, o: F.transform(F.slice(b, 2, BLOCK), lambda x: x + o))
    return F.flatten(joined)


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, hit), in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: g + F.char_length(h))
    place = lambda e, h: F.struct((e - F.char_length(h)).alias("start"), e.alias("end"), h.alias("hit"))
    found = F.zip_with(running_sums(sizes), hits, place)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>"))


def _windows(hit: Column, kind: str, window: int) -> Column:
    """Merged spans (a, b), within the candidate, of the windows with enough entropy."""
    alphabet = ALPHABET[kind]
    bits = (window + 1).bit_length()
    in_long = 62 // bits
    table = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0) for c in range(window + 2)])  # the entering character comes first
    most = math.floor(window * (math.log2(window) - THRESHOLD[kind]) * SCALE)
    first_digit = alphabet.index("0")
    one = lambda b: F.when(b, 1).otherwise(0)

    def cell(ch: Column) -> Column:
        """A character's place in the alphabet: which long, how far in it, and whether it is a digit or a letter."""
        at = F.instr(F.lit(alphabet), ch) - 1
        digit = at.between(first_digit, first_digit + 9)
        letter = ~digit & (at < (16 if kind == "hex" else 62))
        return F.struct(F.floor(at / in_long).cast("int").alias("long"), (at % in_long * bits).alias("shift"), one(digit).alias("digit"), one(letter).alias("letter"))

    def count(s: Column, c: Column) -> Column:
        shifted = F.call_function("shiftright", F.element_at(s["counts"], c["long"] + 1), c["shift"])
        return shifted.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

    unit = lambda c, k: F.when(c["long"] == k, F.call_function("shiftleft", F.lit(1).cast("long"), c["shift"])).otherwise(F.lit(0).cast("long"))

    def judged(s: Column) -> Column:
        """The state with the window that ends at s.at, if it is rich, in the open span or in a new one."""
        rich = (s["at"] >= window) & (s["sum"] <= most) & (s["digits"] >= 2) & (s["letters"] >= 2)
        apart = s["b"] < s["at"] - window
        return F.struct(
            *[s[k].alias(k) for k in ("counts", "sum", "digits", "letters", "at")],
            F.when(rich & apart, s["at"] - window).otherwise(s["a"]).alias("a"),
            F.when(rich, s["at"]).otherwise(s["b"]).alias("b"),
            F.when(rich & apart & (s["b"] > 0), F.array_append(s["spans"], F.struct(s["a"].alias("a"), s["b"].alias("b")))).otherwise(s["spans"]).alias("spans"),
        )

    def enter(s: Column, come: Column) -> Column:
        a = count(s, come)
        return F.struct(
            F.transform(s["counts"], lambda n, k: n + unit(come, k)).alias("counts"),
            (s["sum"] + F.element_at(table, a + 2) - F.element_at(table, a + 1)).alias("sum"),
            (s["digits"] + come["digit"]).alias("digits"),
            (s["letters"] + come["letter"]).alias("letters"),
            (s["at"] + 1).alias("at"),
            *[s[k].alias(k) for k in ("a", "b", "spans")],
        )

    def leave(s: Column, gone: Column) -> Column:
        b = count(s, gone)
        left = F.struct(
            F.transform(s["counts"], lambda n, k: n - unit(gone, k)).alias("counts"),
            (s["sum"] + F.element_at(table, b) - F.element_at(table, b + 1)).alias("sum"),
            (s["digits"] - gone["digit"]).alias("digits"),
            (s["letters"] - gone["letter"]).alias("letters"),
            *[s[k].alias(k) for k in ("at", "a", "b", "spans")],
        )
        return F.when(s["at"] > window, left).otherwise(s)

    # each step is a value of its own, as a field of an expression would be computed once for each use
    chained = lambda s, *steps: s if not steps else F.element_at(F.transform(F.array(chained(s, *steps[:-1])), steps[-1]), 1)
    zero = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // in_long)).alias("counts"),
        *[F.lit(0).alias(k) for k in ("sum", "digits", "letters", "at", "a")],
        F.lit(-1).alias("b"),
        F.array().cast("array<struct<a:int,b:int>>").alias("spans"),
    )
    done = lambda s: F.when(s["b"] > 0, F.array_append(s["spans"], F.struct(s["a"].alias("a"), s["b"].alias("b")))).otherwise(s["spans"])

    def slide(cells: Column) -> Column:
        step = lambda s, i: chained(
            s,
            lambda s: enter(s, F.element_at(cells, i)),
            lambda s: leave(s, F.element_at(cells, F.greatest(i - window, F.lit(1)))),
            judged,
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(cells)), zero, step, done)

    text = F.lower(hit) if kind == "hex" else hit
    return F.element_at(F.transform(F.array(F.transform(F.split(text, ""), cell)), slide), 1)


def find_secrets(documents: DataFrame, text_col: str = "text", window: int = 20, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``documents`` with base_spans and spans, arrays of (start, rank, end, kind) in order.

    Kinds by rank: assign, access, hex, then the method's entropy_hex and entropy_base64. Null or empty texts have none.
    Whole texts are scanned, and rows stay as they are, so repeated rows stay equal; columns named base_spans or spans are
    replaced, other columns of any name are kept; an empty table gives an empty result.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    names = [c for c in documents.columns if c.lower() not in ("base_spans", "spans")]
    assign, access, hexes, run = own = fresh(documents, "_assign", "_access", "_hex", "_run")
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE % window)
    found = documents.withColumns({k: match_spans(text, p) for k, p in zip(own, patterns)}).drop("base_spans", "spans")

    def spans(of: Column, rank: int, kind: str) -> Column:
        return F.transform(of, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    strong = F.filter(assign, lambda m: F.char_length(F.regexp_extract(m["hit"], ASSIGN, 1)) >= 6)
    base = F.array_sort(F.concat(spans(strong, 0, "assign"), spans(F.col(access), 1, "access"), spans(F.col(hexes), 2, "hex")))
    allowed = lambda h: F.greatest(*[h.rlike(p) for p in allow], F.lit(False))
    worth = lambda m: m["hit"].rlike("[0-9]") & m["hit"].rlike("[A-Za-z]") & ~allowed(m["hit"])
    is_hex = lambda m: m["hit"].rlike("^[0-9A-Fa-f]+$")
    found = found.withColumns({"base_spans": base, run: F.filter(run, worth)})

    def rich(rank: int, kind: str) -> Column:
        mine = F.filter(run, is_hex if kind == "hex" else lambda m: ~is_hex(m))
        parts = lambda m: F.transform(
            _windows(m["hit"], kind, window),
            lambda w: F.struct(
                (m["start"] + w["a"]).alias("start"), F.lit(rank).alias("rank"), (m["start"] + w["b"]).alias("end"), F.lit(f"entropy_{kind}").alias("kind")
            ),
        )
        return F.flatten(F.transform(mine, parts))

    new = F.filter(
        F.concat(rich(3, "hex"), rich(4, "base64")),
        lambda s: ~F.exists("base_spans", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])),
    )
    more = F.when(F.size(run) > 0, F.array_sort(F.concat("base_spans", new))).otherwise(F.col("base_spans"))
    return found.withColumn("spans", more).select(*map(quoted, names), "base_spans", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
