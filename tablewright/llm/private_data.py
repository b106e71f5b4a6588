"""Personal data: fixed patterns, and identifiers that the contexts of their matches reveal. DataFrame expressions only.

Matches of the fixed patterns are seeds. The one or two words before a seed are a lexical pattern, and so
are the words before every token that looks like an identifier (four digits or an ``@``, six characters
or more). Patterns and the distinct identifiers they introduce form a graph, scored in ``ROUNDS``:

* a pattern's confidence is the sum of the scores of its identifiers over all it introduces, ordinary
  words included: "the" introduces identifiers too, but mostly other things;
* an unseen identifier's score is the chance that not all confident patterns around it err.

Patterns of at least ``SUPPORT`` identifiers' worth and a confidence of ``SURE`` count as confident, so newly found
identifiers vouch for further patterns in the next round. Every occurrence of an identifier that ends with
a score of ``SURE`` or more becomes a span of the kind ``context``, unless a fixed match overlaps it.

Positions come from splitting a text at the matches: lengths of pieces and matches, summed up. The text patterns
start only where a run of their characters starts or the last match ended, and never step back, so long texts take linear
time. Spans leave their row only as (row, start, end, hashes); a word that precedes a third of all
identifiers is summed up before it is shuffled, and each round is an aggregation and joins of edges.

Null and empty texts have no spans. Repeated rows give repeated results, and one identifier in many rows
counts once for a pattern. An empty table yields no rows. Input columns named like added ones
get the suffix ``_input``. The context words of a match are looked for in the 200 characters before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import maybe_broadcast, set_aside, written

#: Fixed patterns in the order of their kinds, in a form that takes linear time, and what a text with a match must hold.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = [*PATTERNS, "context"]
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Digits of a card and of a phone number.
CARD, PHONE = (12, 19), (9, 15)

#: Tokens with a digit or an at sign; what may stand around an identifier in its token; characters of an identifier.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
OPENING, CLOSING = r"[\"'(<\[{]", r"[.,;:!?\"')>\]}%#$&*|]"
SHORTEST, LONGEST, DIGITS = 6, 64, 4
#: Characters before a match that its context is taken from, and of a context word.
WINDOW, WORD = 200, 24
#: Identifiers' worth that a pattern needs, the confidence that counts, and rounds of scoring.
SUPPORT, SURE, ROUNDS = 3.0, 0.5, 4
#: Most patterns that are sent to all executors (8 to 16 bytes each).
SMALL = 500_000
#: Entries of an array that are summed up in one go.
STEP = 512


def _sums(part: Column) -> Column:
    """The sum of an array of longs, and its running sums."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(part, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x)).alias("all")))


def _blocks(numbers: Column) -> Column:
    """``_sums`` of blocks of an array, so that long arrays are not copied for every entry."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(STEP))
    return F.transform(starts, lambda b: _sums(F.slice(numbers, b, F.lit(STEP))))


def _running(blocks: Column, totals: Column) -> Column:
    """Running sums of the whole array, given those of its blocks and of the blocks' sums."""
    return F.flatten(F.zip_with(blocks, totals, lambda b, total: F.transform(b["all"], lambda x: x + total - b["at"])))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    back = F.reverse(_digits(x))

    def value(i: Column) -> Column:
        digit = F.substr(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(*CARD), _luhn(x)).otherwise(False)
    return F.length(_digits(x)).between(*PHONE) if kind == "phone" else F.lit(True)


def _plain(x: Column) -> Column:
    """Words as patterns know them: lower case, every digit a zero."""
    return F.regexp_replace(F.lower(x), "[0-9]", "0")


def _patterns(words: Column, before: Column) -> Column:
    """Hashes of the pattern of one word and of two; ``before`` may be null."""
    one = F.xxhash64(F.lit(1), F.right(words, F.lit(WORD)))
    return F.array_compact(F.array(one, F.when(before.isNotNull(), F.xxhash64(F.lit(2), F.right(before, F.lit(WORD)), F.right(words, F.lit(WORD))))))


def _tails(pieces: Column, matches: Column) -> Column:
    """What stands before each match: the end of the piece before it, and of the match before that."""

    def one(i: Column) -> Column:
        return F.concat(F.when(i > 0, F.right(F.get(matches, i - 1), F.lit(WINDOW))).otherwise(""), F.right(F.get(pieces, i), F.lit(WINDOW)))

    return F.when(F.size(matches) > 0, F.transform(F.sequence(F.lit(0), F.size(matches) - 1), one)).otherwise(F.array().cast("array<string>"))


def _last_words(tails: Column) -> Column:
    """The words of each tail; none unless a blank and at most opening marks end it."""
    plain = lambda t: F.rtrim(_plain(F.regexp_replace(t, rf"(?<!{OPENING}){OPENING}++$", "")))
    return F.transform(tails, lambda t: F.when(t.rlike(rf"\s{OPENING}*+$"), F.filter(F.split(plain(t), r"\s+"), lambda w: w != "")).otherwise(F.array().cast("array<string>")))


def _contexts(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(F.size(w) > 0, _patterns(F.element_at(w, -1), F.get(w, F.size(w) - 2))).otherwise(F.array().cast("array<bigint>")))


def _found(df: DataFrame, text: Column, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds ``__<name>``: (start, end, what, patterns) of each match of a pattern in ``text``, for each name.

    Step by step, so that nothing is computed twice. A pattern is tried only where its hint holds.
    """
    none = F.array().cast("array<string>")

    def lengths(pieces: Column, matches: Column) -> Column:
        return F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda x, y: (F.length(x) + F.length(y)).cast("long"))

    def spans(ends: Column, matches: Column, contexts: Column) -> Column:
        rows = F.arrays_zip(ends.alias("e"), matches.alias("x"), contexts.alias("p"))
        return F.transform(rows, lambda s: F.struct((s["e"] - F.length(s["x"])).alias("start"), s["e"].alias("end"), s["x"].alias("what"), s["p"].alias("patterns")))

    steps = [
        lambda n, c: {"pieces": F.when(patterns[n][1], F.split(text, patterns[n][0], -1)).otherwise(none), "matches": F.when(patterns[n][1], F.regexp_extract_all(text, F.lit(patterns[n][0]), F.lit(0))).otherwise(none)},
        lambda n, c: {"lengths": lengths(c("pieces"), c("matches")), "tails": _tails(c("pieces"), c("matches"))},
        lambda n, c: {"blocks": _blocks(c("lengths")), "words": _last_words(c("tails"))},
        lambda n, c: {"totals": _sums(F.transform(c("blocks"), lambda b: b["at"]))["all"], "contexts": _contexts(c("words"))},
        lambda n, c: {"ends": _running(c("blocks"), c("totals"))},
        lambda n, c: {"spans": spans(c("ends"), c("matches"), c("contexts"))},
    ]
    before = df.columns
    for step in steps:
        df = df.withColumns({f"__{n}_{what}": column for n in patterns for what, column in step(n, lambda what, n=n: F.col(f"__{n}_{what}")).items()})
    return df.select(*before, *[F.col(f"__{n}_spans").alias(f"__{n}") for n in patterns])


def base_and_tokens(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``__id``, the valid fixed matches of each kind as ``__base``, and tokens like identifiers as ``__tokens``."""
    out = df.select(*[df[c] for c in keep], F.coalesce(df[text], F.lit("")).alias("__text"))
    body = F.col("__text")
    wanted = {kind: (pattern, F.contains(body, F.lit(hint)) if hint else body.rlike("[0-9]")) for kind, (pattern, hint) in PATTERNS.items()}
    out = _found(out, body, wanted | {"token": (TOKEN, body.rlike("[0-9@]"))})

    def core(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["what"], rf"^{OPENING}*+", 0))
        inside = F.regexp_replace(F.substr(s["what"], lead + 1), rf"(?<!{CLOSING}){CLOSING}++$", "")
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(inside)).alias("end"), F.lower(inside).alias("what"), s["patterns"].alias("patterns"))

    def likely(s: Column) -> Column:
        return F.length(s["what"]).between(SHORTEST, LONGEST) & ((F.length(_digits(s["what"])) >= DIGITS) | s["what"].rlike("^[^@]+@[^@]+$"))

    def base(s: Column, number: int) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), F.xxhash64(F.lower(s["what"])).alias("what"), s["patterns"].alias("patterns"))

    def valid(kind: str, number: int) -> Column:
        checked = F.filter(f"__{kind}", lambda s: _valid(kind, s["what"]))
        return F.transform(checked, lambda s: base(s, number))

    kinds = [valid(kind, number) for number, kind in enumerate(PATTERNS)]
    tokens = F.transform(F.filter(F.transform("__token", core), likely), lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("kind"), s["end"].alias("end"), F.xxhash64(s["what"]).alias("what"), s["patterns"].alias("patterns")))
    return out.select(*[F.col(c) for c in keep], F.monotonically_increasing_id().alias("__id"), F.array_sort(F.concat(*kinds)).alias("__base"), tokens.alias("__tokens"))


def _free(spans: DataFrame) -> DataFrame:
    """The spans (id, start, kind, end, what, patterns) without the tokens that a fixed match overlaps."""
    up = Window.partitionBy("id").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("id").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("kind") >= 0
    marked = spans.withColumn("reach", F.max(F.when(fixed, F.col("end"))).over(up)).withColumn("next", F.min(F.when(fixed, F.col("start"))).over(down))
    clear = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return marked.filter(fixed | clear).drop("reach", "next")


def _slots(df: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how many words or identifiers follow each of the ``patterns`` in all texts."""
    words = df.select(F.split(F.btrim(_plain(F.col(text)), F.lit(" \t\n\x0b\f\r")), r"\s+").alias("w"))
    pairs = words.filter(F.size("w") > 1).select(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("last"), F.concat(F.array(F.lit(None).cast("string")), F.slice("w", F.lit(1), F.size("w") - 2)).alias("before")).alias("pairs"))
    each = pairs.select(F.inline("pairs").alias("last", "before")).select(F.explode(_patterns(F.col("last"), F.col("before"))).alias("pattern"))
    return each.join(maybe_broadcast(patterns, SMALL), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def score_graph(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (pattern, confidence) and unseen identifiers with their scores (what, score).

    ``edges``: (pattern, what, seed, n), distinct in pattern and identifier; ``totals``: (pattern, total).
    """
    sums = edges.groupBy("pattern").agg(F.count("*").alias("different"), F.sum("n").alias("times"))
    size = written(sums.join(totals, "pattern").select("pattern", (F.col("different") + F.greatest(F.col("total") - F.col("times"), F.lit(0))).alias("size")), "sizes")
    edges = written(edges.join(maybe_broadcast(size.select("pattern"), SMALL), "pattern", "left_semi"), "edges")
    found, confident = edges.filter("false").select("what", F.lit(0.0).alias("score")), None
    for _ in range(rounds):
        known = edges.filter("seed").select("pattern", F.lit(1.0).alias("score"))
        guessed = edges.filter("not seed").join(found, "what").select("pattern", "score")
        worth = known.unionByName(guessed).groupBy("pattern").agg(F.sum("score").alias("worth")).filter(F.col("worth") >= SUPPORT)
        sure = worth.join(size, "pattern").select("pattern", F.least(F.col("worth") / F.col("size"), F.lit(0.999)).alias("confidence"))
        confident = written(sure.filter(F.col("confidence") >= SURE), "patterns")
        if confident.isEmpty():  # nothing is found, now or in a later round
            return confident, edges.filter("false").select("what", F.lit(0.0).alias("score"))
        err = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        found = written(edges.filter("not seed").join(maybe_broadcast(confident, SMALL), "pattern").groupBy("what").agg((1 - err).alias("score")), "identifiers")
    return confident, found


def find_private(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, counts by kind, digest of the fixed spans, and all spans ``kind:start:end``."""
    added = [*(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
    df = set_aside(df, *added)
    keep = [f"{c}_input" if c.lower() in added else c for c in keep]
    text = f"{text}_input" if text.lower() in added else text
    rows = written(base_and_tokens(df, text, keep), "private")
    every = [rows.filter(F.size(c) > 0).select(F.col("__id").alias("id"), F.inline(c)) for c in ("__base", "__tokens")]
    spans = written(_free(every[0].unionByName(every[1])), "spans")

    seen = spans.select(F.explode("patterns").alias("pattern"), "what", (F.col("kind") >= 0).alias("seed"))
    edges = seen.groupBy("pattern", "what").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    # A fixed match is a seed in every context, also where only a token of the same text was seen.
    enough = edges.groupBy("pattern").agg(F.count("*").alias("different")).filter(F.col("different") >= SUPPORT).select("pattern")
    enough = written(enough, "contexts")
    totals = written(_slots(df, text, enough), "slots")
    _, found = score_graph(edges.join(maybe_broadcast(enough, SMALL), "pattern", "left_semi"), totals)

    fresh = spans.filter("kind < 0").join(found.filter(F.col("score") >= SURE).select("what"), "what", "left_semi")
    context = KINDS.index("context")
    more = fresh.groupBy("id").agg(F.collect_set(F.struct("start", F.lit(context).alias("kind"), "end")).alias("__more")).withColumnRenamed("id", "__id")
    out = rows.join(more, "__id", "left")
    fixed = F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = out.withColumn("__fixed", fixed).withColumn("__more", F.coalesce("__more", none)).withColumn("__every", F.array_sort(F.concat("__fixed", "__more")))

    def joined(column: str) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(number: int) -> Column:
        return F.size(F.filter("__every", lambda s: s["kind"] == number)).cast("long")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    return out.select(*keep, *counts, F.sha2(joined("__fixed"), 256).alias("base_sha256"), joined("__every").alias("spans"))
