"""Texts cut off by a length limit or in transfer.

From all texts one table of counts is made, in one explosion: for every word, how
often it stands inside a text and how often a sentence ends after it; for every
three words, how often they open a sentence and how often they stand within one.
The known words' proper prefixes, one row each, are the nodes of a trie, and the
words after which sentences end bear its end marks.  Four kinds of evidence make a
text without a sentence's end, or with an ellipsis for it, a cut one:

* ``prefix``: its last word is no known word, but a proper prefix of one;
* ``limit``: it has a length at which texts of its source end so again and again;
* ``unended``: its last word is known, but bears no end mark;
* ``begun``: without an ellipsis only: it begins as sentences do, by the counts of
  openings, or ends as neither headings nor sentences do.

A heading is thus told by counts: no three words in it open sentences, and its last
word ends other headings, or sentences.

Texts meet these tables by joins; nothing of the vocabulary is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut

#: Marks that end a sentence, and quotes and brackets that may close behind them (fixed values).
_END = ".!?。！？…"
_CLOSE = "»”“\"」』)）\\]’'"

#: What may stand behind a finished text without belonging to it: symbols, numbers as tags, markers.
_DECOR = r"(?:[\s\p{So}\p{Sk}\p{Sm}\x{200b}-\x{200f}\x{fe0f}\x{feff}\x{a0}]|#\d+|<\|?/?[A-Za-z_]+/?\|?>|\[[A-Z/]{2,12}\]|&[a-z]+;)+$"

#: Codes in brackets belong to the word before them.
_CODE = r"\s?[(（][A-Z]-[0-9]+[)）]"

#: A word of letters, one Han character, or the end of a sentence.
_TOKEN = r"\p{IsHan}|[\p{L}\p{M}\p{Nd}\x{fffd}]+(?:['’\-][\p{L}\p{M}\p{Nd}]+)*['’]?|[.!?。！？…]+"


@dataclass(frozen=True)
class Evidence:
    """``known``: times that a word must stand inside texts; ``end_rate``: share of its places after which a sentence must end;
    ``open_rate``: share of its places at which three words must open a sentence to be no part of a heading; ``heading_rate``: share of its places in headings that must be their last;
    ``limit_share``: share of a source's ellipses at one length that makes it a limit; ``limit_texts``: texts it needs."""

    known: int = 2
    end_rate: float = 0.01
    open_rate: float = 0.05
    heading_rate: float = 0.5
    limit_share: float = 0.2
    limit_texts: int = 5


def tokens(text: Column) -> Column:
    """Lower-case words, Han characters and sentence ends ('.') of a text."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace(text, _CODE, "")), F.lit(_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(F.instr(F.lit(_END), F.substring(t, 1, 1)) > 0, F.lit(".")).otherwise(t))


def _is_han(t: Column) -> Column:
    return (F.length(t) == 1) & t.rlike(r"^\p{IsHan}$")


def final_key(t: Column, i: Column) -> Column:
    """The word at place ``i`` (from 1); for Han the last two characters."""
    last, before = F.try_element_at(t, i), F.try_element_at(t, F.greatest(i - 1, F.lit(1)))
    return F.when(_is_han(last) & (i > 1) & _is_han(before), F.concat(before, last)).otherwise(last)


def prepare(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, ending, t): the text without what was put behind it, and how it ends.

    ``ending`` is ``full``, ``dots`` or ``open``; ``t`` are the tokens before the end.
    """
    bare = F.regexp_replace(F.regexp_replace("text", _DECOR, ""), f"[{_CLOSE}\\s\\x{{a0}}]+$", "")
    shown = docs.select("doc_id", "source", "text", bare.alias("_bare"))
    # A quote or bracket behind a blank opens something that doesn't follow.
    dots = F.col("_bare").rlike(r"(?:\.\.\.|…)$")
    opened = F.regexp_replace("text", _DECOR, "").rlike(r"\s[“„«「『(（\"]$")
    ending = F.when(opened, "open").when(dots, "dots").when(F.col("_bare").rlike(f"[{_END}]$"), "full").otherwise("open")
    body = F.when(dots, F.regexp_replace("_bare", r"(?:\.\.\.|…)+$", "")).otherwise(F.col("_bare"))
    return shown.select("doc_id", "source", F.length(F.rtrim("text")).alias("n_chars"), ending.alias("ending"), opened.alias("opened"), tokens(body).alias("t"))


def count_table(prepared: DataFrame) -> DataFrame:
    """(kind, key, n, k): of each word (``word``) its places inside texts, and those after which a sentence ends; of each three words
    (``opening``) their places, and those at the start of a sentence.

    The last word of a text counts only where the text has a full end.  Starts are
    counted in texts of at least one full sentence, so headings don't count as
    openings of sentences.
    """
    n = F.size("t")
    sentences = F.expr("ending = 'full' or array_contains(t, '.')")

    def place(i: Column) -> Column:
        here, nxt = F.try_element_at("t", i), F.try_element_at("t", i + 1)
        third = F.try_element_at("t", i + 2)
        before = F.when(i > 1, F.try_element_at("t", F.greatest(i - 1, F.lit(1))))
        word = F.struct(F.lit("word").alias("kind"), final_key(F.col("t"), i).alias("key"), F.coalesce(nxt == ".", F.lit(False)).alias("flag"))
        opening = F.struct(F.lit("opening").alias("kind"), F.concat_ws(" ", here, nxt, third).alias("key"), (before.isNull() | (before == ".")).alias("flag"))
        return F.array(F.when((here != ".") & (i < n), word), F.when(sentences & (i + 2 <= n) & (here != ".") & (nxt != ".") & (third != "."), opening))

    # One small struct per place and kind: a row never carries its whole text along.
    rows = prepared.where(n > 0).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), place))).alias("w")).where("w is not null").select("w.*")
    return rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("k"))


def trie_nodes(words: DataFrame, e: Evidence) -> DataFrame:
    """(prefix): every proper prefix of a known word, once."""
    known = words.where((F.col("n") >= e.known) & (F.length("key") > 1))
    ends = F.sequence(F.lit(1), F.length("key") - 1)
    return known.select(F.explode(F.transform(ends, lambda k: F.substring(F.col("key"), F.lit(1), k))).alias("prefix")).distinct()


def headings(prepared: DataFrame, openings: DataFrame, e: Evidence) -> DataFrame:
    """(doc_id): texts without any sentence's end in which no three words are such as open sentences.

    A repeated doc_id is listed once, for its first text.
    """
    bare = prepared.where("ending = 'open' and size(t) > 0 and not array_contains(t, '.')").groupBy("doc_id").agg(F.min("t").alias("t"))
    bare = bare.select("doc_id", "t", F.size("t").alias("n"))
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))), lambda i: F.concat_ws(" ", *[F.try_element_at("t", i + k) for k in range(3)]))
    each = bare.select("doc_id", F.explode(triples).alias("triple")).join(openings, "triple", "left")
    rate = F.coalesce(F.col("n_start") / (F.col("n_start") + F.col("n_within")), F.lit(0.0))
    like = each.groupBy("doc_id").agg(F.max(rate).alias("rate")).where(F.col("rate") < e.open_rate)
    return bare.join(like, "doc_id", "left_semi").select("doc_id", "t", "n")


def heading_ends(candidates: DataFrame) -> DataFrame:
    """(key, n_heading, n_last): places of a word in such texts, and those at their end."""
    place = lambda i: F.struct(final_key(F.col("t"), i).alias("key"), (i == F.col("n")).alias("last"))
    rows = candidates.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), place)).alias("w")).select("w.*")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_heading"), F.count_if("last").alias("n_last"))


def limits(prepared: DataFrame, e: Evidence) -> DataFrame:
    """(source, ending, n_chars): lengths at which a source puts its ellipses, or breaks off."""
    at = prepared.where("ending <> 'full'").groupBy("source", "ending", "n_chars").agg(F.count(F.lit(1)).alias("k"))
    total = at.groupBy("source", "ending").agg(F.sum("k").alias("all"))
    at = at.join(total, ["source", "ending"]).where((F.col("k") >= e.limit_texts) & (F.col("k") >= F.col("all") * e.limit_share))
    # Blanks are stripped before an ellipsis is put, so the length just below a limit is one too.
    lower = F.explode(F.when(F.col("ending") == "dots", F.array(F.col("n_chars"), F.col("n_chars") - 1)).otherwise(F.array("n_chars")))
    return at.select("source", "ending", lower.alias("n_chars")).distinct()


def judge(docs: DataFrame, e: Evidence = Evidence()) -> DataFrame:
    """(doc_id, source, ending, evidence, is_cut) of each document (doc_id, source, text) whose text isn't blank.

    ``evidence`` lists what speaks for a cut, in the order ``prefix``, ``limit``,
    ``unended``, ``begun``; it is empty for a text that isn't cut.  Null and blank
    texts give no row; a text without any letter is not cut; texts of any length are
    read whole; repeated rows are judged alike, each for itself.  A null source has
    no length limit of its own.
    """
    docs = docs.select("doc_id", "source", "text").where(F.regexp_replace("text", r"[\s\x{a0}\x{feff}]+", "") != "")
    prepared = cut(prepare(docs), "prepared")
    counts = cut(count_table(prepared), "counts")
    words = counts.where("kind = 'word'").select("key", "n", F.col("k").alias("n_end"))
    openings = counts.where("kind = 'opening'").select(F.col("key").alias("triple"), F.col("k").alias("n_start"), (F.col("n") - F.col("k")).alias("n_within"))
    n = F.size("t")
    ask = prepared.where("ending <> 'full' and size(t) > 0").select(
        "doc_id", "source", "ending", "n_chars", final_key(F.col("t"), n).alias("key"), ((F.element_at("t", -1) == ".") & ~F.col("opened")).alias("at_end")
    )
    candidates = cut(headings(prepared, openings, e), "headings")
    found = (
        ask.join(words.withColumnRenamed("n", "n_word"), "key", "left")
        .join(trie_nodes(words, e).select(F.col("prefix").alias("key"), F.lit(True).alias("is_prefix")), "key", "left")
        .join(heading_ends(candidates), "key", "left")
        .join(candidates.select("doc_id", F.lit(True).alias("bare")), "doc_id", "left")
        .join(limits(prepared, e).withColumn("at_limit", F.lit(True)), ["source", "ending", "n_chars"], "left")
    )
    is_known = F.coalesce(F.col("n_word") >= e.known, F.lit(False))
    broken = ~is_known & F.coalesce("is_prefix", F.lit(False))
    may_end = is_known & (F.col("n_end") >= F.greatest(F.lit(1.0), F.col("n_word") * e.end_rate))
    ends_heading = F.coalesce((F.col("n_last") >= 2) & (F.col("n_last") >= F.col("n_heading") * e.heading_rate), F.lit(False))
    bare = F.coalesce("bare", F.lit(False))
    heading = bare & ends_heading
    told = {
        "prefix": broken & ~heading,
        "limit": F.coalesce("at_limit", F.lit(False)) & ~heading,
        "unended": is_known & ~may_end & ~heading,
        "begun": (F.col("ending") == "open") & ~(bare & (ends_heading | may_end)),
    }
    evidence = F.filter(F.array(*[F.when(c & ~F.col("at_end"), F.lit(name)) for name, c in told.items()]), lambda x: x.isNotNull())
    judged = found.select("doc_id", "source", "ending", evidence.alias("evidence"))
    rest = prepared.where("ending = 'full' or size(t) = 0").select("doc_id", "source", "ending", F.array().cast("array<string>").alias("evidence"))
    return judged.unionByName(rest).withColumn("is_cut", F.size("evidence") > 0)


def evidence_report(judged: DataFrame) -> DataFrame:
    """(ending, evidence, n_cut): cut texts by how they end and what tells them, kinds of evidence joined by '+'."""
    return judged.where("is_cut").groupBy("ending", F.array_join("evidence", "+").alias("evidence")).agg(F.count(F.lit(1)).alias("n_cut"))


def cut_share(judged: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share_cut) per source."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut")).withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6))
