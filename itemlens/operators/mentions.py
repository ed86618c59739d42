"""Counting texts that mention patterns, titles or names.

Needles and texts meet on short runs of characters (grams). Each needle is known by the one of its own that a sample of the
corpus has least often. Equal texts become one row, dealt out by their hashes; there a regular expression and a bitmap,
both of a fixed size, let through the grams that needles are known by, so that little is exploded but what is a
candidate. The corpus is read alike for one needle or for millions, and no text is compared with all of them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.text import title_probe
from itemlens.session import checkpointed, dealt, stored

GRAMS = (4, 8, 16)  # characters of a gram: the most of these that a needle has; a needle of fewer is its own
PART = 1 << 16  # characters of a text that are looked at in one go
CLASS = 200  # most characters that a place of the regular expression names
SAMPLE, SAMPLE_CHARS = 256, 4096  # texts, and characters of each, that tell common grams from rare ones: this changes times only
SLOTS = 8  # a gram that very many texts have is met in so many tasks


def build_corpus(*parts: DataFrame) -> DataFrame:
    """One text column from several; rows without text are kept as null."""
    texts = [p.select(F.col(p.columns[0]).alias("text")) for p in parts]
    return reduce(DataFrame.union, texts)


def any_pattern(patterns: list[str]) -> str:
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


GRADED = [(name, patterns) for name, _, patterns in K.GRADED_SCHEMES]


def count_pattern_mentions(corpus: DataFrame, text: str, entries: list[tuple[str, list[str]]] = GRADED,
                           name: str = "name", out: str = "mentions") -> DataFrame:
    """Texts with at least one hit per entry of a fixed table (the graded schemes), in one pass.

    ``entries`` is [(name, patterns)]; one aggregate column each, then unpivoted.
    """
    one_row = dealt(corpus.select(text), text).agg(*[
        F.count_if(F.col(text).rlike(any_pattern(patterns))).alias(f"e{i}") for i, (_, patterns) in enumerate(entries)])
    pairs = F.array(*[F.struct(F.lit(n).alias(name), F.col(f"e{i}").alias(out)) for i, (n, _) in enumerate(entries)])
    return one_row.select(F.inline(pairs))


def flattened(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def distinct_texts(corpus: DataFrame, text: str) -> DataFrame:
    """(t1, t2, m, raw): the lower-cased texts, equal ones as one row with their number, written once."""
    lowered = F.lower(F.col(text))
    rows = corpus.filter(F.col(text).isNotNull()).select(lowered.alias("raw"), F.xxhash64(lowered).alias("t1"), F.xxhash64(F.lit(1), lowered).alias("t2"))
    return stored(rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("m"), F.first("raw").alias("raw")), "texts")


def parts_of(text: Column, more: int) -> Column:
    """A text in parts of ``PART`` characters, each with ``more`` characters of the next."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / F.lit(PART)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * PART + 1, F.lit(PART + more)))


def runs_of(text: Column, shape: str) -> Column:
    """The distinct runs of characters that ``shape`` describes, wherever they begin."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({shape}))"), F.lit(1)))


def anchored(needles: DataFrame, texts: DataFrame, view) -> DataFrame:
    """``needles`` (id, x, needle) with ``gram``: the run of each that the sample of ``texts`` has least often."""
    needle = F.col("needle")
    own = F.array(needle)
    for k in GRAMS:
        own = F.when(F.length(needle) >= k, runs_of(needle, f".{{{k}}}")).otherwise(own)
    grams = needles.withColumn("gram", F.explode(own))
    head = view(F.substring("raw", 1, SAMPLE_CHARS))
    some = texts.limit(SAMPLE).select(F.explode(F.concat(*[runs_of(head, f".{{{k}}}") for k in GRAMS])).alias("gram"))
    seen = some.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)), F.xxhash64("gram"), "gram"))
    return checkpointed(grams.join(seen, "gram", "left").groupBy("id").agg(rarest["gram"].alias("gram"), F.first("x").alias("x")))


class Screen:
    """Which grams may be a needle's: for each length the characters at each place, and a bitmap of hashes of 8 times as many bits as there are
    needles (4,096 to 4,194,304). That is all the driver reads of them."""

    def __init__(self, keys: DataFrame):
        shapes = keys.groupBy(F.length("gram").alias("k")).agg(F.count(F.lit(1)).alias("n"), *[
            F.slice(F.collect_set(F.substring("gram", i + 1, 1)), 1, CLASS + 1).alias(f"c{i}") for i in range(GRAMS[-1])]).collect()
        self.shapes = {r.k: "".join(self.place(r[f"c{i}"]) for i in range(r.k)) for r in shapes if r.k}
        self.everywhere = any(r.k == 0 for r in shapes)  # every text has the empty needle
        self.bits = 12
        while self.bits < 22 and 1 << self.bits < 8 * sum(r.n for r in shapes):
            self.bits += 1
        at = self.number(F.col("gram"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 63).cast("int"))
        words = dict(keys.groupBy(F.floor(at / 63).alias("w")).agg(F.bit_or(one)).collect())
        every = ",".join(str(words.get(i, 0)) for i in range((1 << self.bits) // 63 + 1))
        self.bitmap = F.split(F.lit(every), ",").cast("array<long>")  # a constant to the planner

    def number(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(1 << self.bits))

    @staticmethod
    def place(chars: list[str]) -> str:
        return "." if len(chars) > CLASS else "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars)) + "]"

    def grams(self, text: Column) -> Column:
        """The distinct grams of a text that may be a needle's."""
        def may_be(gram):
            at = self.number(gram)
            word = F.get(self.bitmap, F.floor(at / 63).cast("int"))
            return F.call_function("shiftright", word, (at % 63).cast("int")).bitwiseAND(F.lit(1)) == 1

        found = [F.filter(runs_of(text, shape), may_be) for shape in self.shapes.values()]
        return F.concat(*found, F.array(F.lit("")) if self.everywhere else F.array().cast("array<string>"))


def candidates(texts: DataFrame, keys: DataFrame, view) -> DataFrame:
    """(t1, t2, x): the needles of ``keys`` (x, gram) whose gram a text has."""
    screen = Screen(keys)
    part = texts.select("t1", "t2", F.explode(parts_of(view(F.col("raw")), GRAMS[-1] - 1)).alias("part"))
    grams = part.select("t1", "t2", F.explode(screen.grams(F.col("part"))).alias("gram")).withColumn("slot", F.pmod("t1", F.lit(SLOTS)).cast("int"))
    spread = keys.select("x", "gram", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    return grams.join(spread, ["gram", "slot"]).select("t1", "t2", "x").distinct()


def _hits(corpus: DataFrame, text: str, needles: DataFrame, hit, fields: list[str], view=lambda raw: raw) -> DataFrame:
    """(id, m) for each needle and distinct text that has it, m being the copies of the text; ``hit(raw, flat, needle)`` says so.

    ``needles`` (id, fields with ``needle``) must be cheap to read again. ``view`` is how texts and needles are looked at to find
    candidates: it must keep what a text contains.
    """
    texts = distinct_texts(corpus, text)
    shaped = needles.select("id", F.struct("id", *fields).alias("x"), view(F.col("needle")).alias("needle"))
    found = candidates(texts, anchored(shaped, texts, view), view).groupBy("t1", "t2").agg(F.collect_list("x").alias("xs"))
    both = found.join(texts, ["t1", "t2"]).withColumn("flat", view(F.col("raw")))
    kept = F.filter("xs", lambda x: hit(F.col("raw"), F.col("flat"), x))
    return both.select("m", F.explode(F.transform(kept, lambda x: x["id"])).alias("id"))


def _count_hits(corpus: DataFrame, text: str, needles: DataFrame, hit, fields: list[str], view=lambda raw: raw) -> DataFrame:
    """(id, n): the texts that have each needle; needles without any are left out."""
    return _hits(corpus, text, needles, hit, fields, view).groupBy("id").agg(F.sum("m").alias("n"))


def _holds(raw: Column, flat: Column, x: Column) -> Column:
    return F.contains(raw, x["needle"])


def _plain_needles(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull()).select(
        F.col(name).alias("id"), F.lower(F.col(name)).alias("needle")).distinct()


def count_title_mentions(corpus: DataFrame, text: str, terms: DataFrame, term: str, out: str) -> DataFrame:
    """Per term: texts that contain it, any case; 0 when none."""
    terms = checkpointed(terms)
    hits = _count_hits(corpus, text, _plain_needles(terms, term), _holds, ["needle"])
    return terms.join(hits.withColumnRenamed("id", term), term, "left").withColumn(
        out, F.coalesce("n", F.lit(0))).drop("n")


def flag_mentioned(names: DataFrame, name: str, corpus: DataFrame, text: str, out: str = "mentioned") -> DataFrame:
    """Does any text contain the name, any case; null when there is no name."""
    names = checkpointed(names)
    hits = _hits(corpus, text, _plain_needles(names, name), _holds, ["needle"]).select("id").distinct()  # one hit is enough
    return names.join(hits.select(F.col("id").alias(name), F.lit(True).alias("_hit")), name, "left").withColumn(
        out, F.when(F.col(name).isNotNull(), F.col("_hit").isNotNull())).drop("_hit")


def count_catalogue_mentions(corpus: DataFrame, text: str, titles: DataFrame, title: str, out: str = "mentions") -> DataFrame:
    """Per distinct title: texts hit by its derived pattern; 0 when none.

    A phrase pattern allows any blanks between its words, so it is a plain search
    in the text with blanks collapsed; an acronym is searched first and its word
    edges checked on the few hits.
    """
    probes = titles.select(F.col(title).alias("id")).distinct().withColumn("probe", title_probe(F.col("id")))
    probes = checkpointed(probes.select("id", "probe.*"))

    def hit(raw: Column, flat: Column, x: Column) -> Column:
        return (
            F.when(x["kind"] == "phrase", F.contains(flat, x["needle"]))
            .when(x["kind"] == "title", F.contains(raw, x["needle"]))
            .otherwise(F.contains(raw, x["needle"]) & F.rlike(raw, F.concat(F.lit("(?iU)"), x["pattern"])))
        )

    # blanks collapse alike in a text and in what it contains
    hits = _count_hits(corpus, text, probes, hit, ["kind", "needle", "pattern"], flattened)
    return probes.select("id", "pattern").join(hits, "id", "left").select(
        F.col("id").alias(title), "pattern", F.coalesce("n", F.lit(0)).alias(out))
