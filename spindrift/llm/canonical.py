"""Mapping typed values to the entries of a reference list.

Two set-similarity joins decide.  Both order their tokens by how rare they are in
both sides together, join only the rarest tokens of each set, drop candidates by
length and position, compute Jaccard exactly and keep the best.

1. Words: every distinct typed word becomes a set of letter groups and meets the
   words of the list and their aliases: prefixes as abbreviations, neighbouring
   words run together, initials.  The best alias stands for the word.
2. Names: every distinct set of words found in this way meets the entries' sets of
   words.

Nothing is listed beforehand.  Words that another word of an entry always brings
along (as every "stromal" has its "cell") say nothing and count on neither side.
A word unknown to the list is an annotation if most of the values that hold it
name an entry completely without it; any other unknown word counts against all
entries.  Values left without an entry, of which not every word is one of the list,
are read once more as one run of letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut

#: Least Jaccard similarity of a typed word to a word or prefix, of a run of letters to several words, of the words of a value to an entry.
MIN_WORD, MIN_RUN, MIN_NAME = 0.45, 0.6, 0.8

#: Cyrillic and Greek letters that look like Latin ones (fixed values).
_LOOKALIKES = str.maketrans("авекмнорстухіјѕοανιρτυχАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxijsoaviptyxABEKMHOPCTYXIJSABEZHIKMNOPTYX")

_ROMAN = {"i": 1, "v": 5, "x": 10}


def _greek(text: str) -> str:
    """Greek letters that end a word, by their names."""
    out = []
    for i, c in enumerate(text):
        alone = not text[i + 1 : i + 2].isalpha() and (i == 0 or not text[i - 1].isalpha() or text[i - 1].isascii())
        name = unicodedata.name(c, "").split()
        out.append(f" {name[-1].lower()} " if alone and len(name) == 4 and name[0] == "GREEK" and name[2] == "LETTER" else c)
    return "".join(out)


def plain_words(value: str) -> list[str]:
    """The words and numbers of a value: lower case, plain letters; words run together in mixed case are parted."""
    text = _greek(unicodedata.normalize("NFKC", value))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_LOOKALIKES)
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"(?<=[a-z]{2})(?=[A-Z])", " ", text).lower())


def numeral(word: str) -> str:
    """Roman numerals of i, v and x as numbers; other words stay."""
    if not re.fullmatch(r"[ivx]+", word):
        return word
    values = [_ROMAN[c] for c in word]
    return str(sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0], strict=True)))


def fold(value: str | None) -> str:
    """A value as its plain words, numerals as numbers, parted by blanks."""
    return " ".join(numeral(w) for w in plain_words(value or ""))


def letter_groups(word: str) -> list[str]:
    """The tokens of a word: its pairs of neighbours, and regardless of order its pairs at most two apart and its triples.

    So one slip, or two letters swapped, leaves most tokens.  Equal tokens are
    numbered.  A number is one token: it is like no other.
    """
    if not word or word.isdigit():
        return ["#" + word] if word else []
    s = f"^{word}$"
    found = [s[i : i + 2] for i in range(len(s) - 1)]
    found += ["~" + "".join(sorted(s[i] + s[i + d])) for d in (1, 2) for i in range(len(s) - d)]
    found += ["~" + "".join(sorted(s[i : i + 3])) for i in range(len(s) - 2)]
    seen: Counter[str] = Counter()
    out = []
    for t in found:
        seen[t] += 1
        out.append(f"{t}{seen[t]}")
    return out


def aliases(name: str, light: frozenset[str]) -> list[tuple[str, int, list[str]]]:
    """(alias, kind, words) of an entry: its words (kind 0), names for the whole entry (1) and for parts of it (2)."""
    written = plain_words(name)
    words = [numeral(w) for w in written]
    out = {(w, 0, (w,)) for w in words}
    out |= {(w[:k], 2, (w,)) for w in words if not w.isdigit() for k in range(2, len(w))}
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            run = tuple(words[i:j])
            kind = 1 if len(run) == len(words) else 2
            out |= {("".join(run), kind, run), ("".join(written[i:j]), kind, run)}
            if len(run) > 2:
                out |= {("".join(w[0] for w in run), kind, run)}
            if len(run) > 3:
                out |= {("".join(w[0] for w in run if w != x), kind, run) for x in light & set(run)}
    return sorted((a, k, sorted(set(w))) for a, k, w in out)


def _ordered(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """(key, t): tokens from rare to frequent."""
    each = sets.select("key", F.explode("t").alias("token")).join(rarity, "token")
    lists = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("_t"))
    return lists.select("key", F.transform("_t", lambda x: x["token"]).alias("t"))


def _prefixes(ordered: DataFrame, least: float) -> DataFrame:
    n = F.size("t")
    keep = n - F.ceil(n * F.lit(least) - 1e-9).cast("int") + 1
    return ordered.select("key", n.alias("n"), F.posexplode(F.slice("t", F.lit(1), keep)).alias("at", "token"))


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_key, right_key, jaccard) of all pairs of sets (key, tokens) with a Jaccard similarity of at least ``least``.

    Exact: the filters drop only pairs below ``least``.  Candidates are pairs of
    keys; the sets join them once they are distinct.  Empty sets are similar to
    none; a repeated key counts once, with any of its sets.
    """
    code = lambda df: df.groupBy("key").agg(F.first("tokens").alias("tokens")).select("key", F.transform(F.array_distinct("tokens"), lambda x: F.xxhash64(x)).alias("t"))
    left, right = cut(code(left), "left"), cut(code(right), "right")
    rarity = left.select(F.explode("t").alias("token")).unionByName(right.select(F.explode("t").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    both = _ordered(left.select(F.struct(F.lit(0).alias("s"), "key").alias("key"), "t").unionByName(right.select(F.struct(F.lit(1).alias("s"), "key").alias("key"), "t")), rarity)
    heads = cut(_prefixes(both, least), "heads")
    a = heads.where("key.s = 0").select(F.col("key.key").alias("left_key"), F.col("n").alias("nl"), F.col("at").alias("i"), "token")
    b = heads.where("key.s = 1").select(F.col("key.key").alias("right_key"), F.col("n").alias("nr"), F.col("at").alias("j"), "token")
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("nl") + F.col("nr")) - 1e-9)
    long_enough = (F.col("nl") >= F.col("nr") * least - 1e-9) & (F.col("nr") >= F.col("nl") * least - 1e-9)
    met = a.join(b, "token").where(long_enough & (F.least(F.col("nl") - F.col("i"), F.col("nr") - F.col("j")) >= need))
    pairs = met.select("left_key", "right_key").distinct()
    shown = pairs.join(left.select(F.col("key").alias("left_key"), F.col("t").alias("lt")), "left_key").join(right.select(F.col("key").alias("right_key"), F.col("t").alias("rt")), "right_key")
    shared = F.size(F.array_intersect("lt", "rt"))
    return shown.select("left_key", "right_key", (shared / (F.size("lt") + F.size("rt") - shared)).alias("jaccard")).where(F.col("jaccard") >= least - 1e-12)


def _udf(kind: str, f) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f)

    return run


def light_words(entries: DataFrame) -> DataFrame:
    """(word): words that in each of their entries some other, rarer word of several entries always brings along."""
    each = entries.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).where("word <> ''")
    n = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    two = each.select("name", F.col("word").alias("v")).join(each, "name").where("v <> word")
    bound = two.groupBy("v", "word").agg(F.count(F.lit(1)).alias("both")).join(n.toDF("v", "nv"), "v").join(n, "word").where("both = nv and n > nv and nv > 1")
    brought = two.join(bound.select("v", "word"), ["v", "word"], "left_semi").select("name", "word").distinct()
    return brought.groupBy("word").agg(F.count(F.lit(1)).alias("b")).join(n, "word").where("b = n").select("word")


def alias_table(entries: DataFrame, light: DataFrame) -> DataFrame:
    """(alias, core, several, is_word): what each alias stands for, without the light words; ``several`` words or one; whether it is a word of the list.

    A word of the list stands for itself; else an alias stands for the only entry
    it names whole, else for the only words it can mean, else for nothing.
    """
    kind = "array<struct<alias: string, kind: int, words: array<string>>>"

    @F.pandas_udf(kind)
    def build(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, lights in batches:
            yield pd.Series([[{"alias": a, "kind": k, "words": w} for a, k, w in aliases(n, frozenset(x))] for n, x in zip(names, lights, strict=True)])

    words = entries.select("raw", "name", F.explode(F.split("name", " ")).alias("word")).join(light.withColumn("_light", F.lit(True)), "word", "left")
    shown = words.groupBy("raw").agg(F.collect_set(F.when(F.col("_light"), F.col("word"))).alias("light"))
    each = shown.select("light", F.explode(build("raw", "light")).alias("a")).select("a.*", F.array_except("a.words", "light").alias("core"))
    got = each.groupBy("alias").agg(
        *[F.count_distinct(F.when(F.col("kind") == k, F.col("core"))).alias(f"n{k}") for k in (0, 1)],
        F.count_distinct("core").alias("n"),
        *[F.max(F.when(F.col("kind") == k, F.struct("core", (F.size("words") > 1).alias("several")))).alias(f"m{k}") for k in (0, 1)],
        F.max(F.struct("core", (F.size("words") > 1).alias("several"))).alias("m"),
    )
    one = F.when(F.col("n0") > 0, F.col("m0")).when(F.col("n1") == 1, F.col("m1")).when(F.col("n") == 1, F.col("m"))
    return got.select("alias", one.alias("m"), (F.col("n0") > 0).alias("is_word")).where("m is not null").select("alias", "m.core", "m.several", "is_word")


def best_alias(words: DataFrame, known: DataFrame, min_word: float, min_run: float) -> DataFrame:
    """(word, core, exact): what each distinct word stands for, by the alias of the highest Jaccard similarity; whether it is a word of the list as it stands."""
    groups = _udf("array<string>", letter_groups)
    pairs = similar_sets(words.select(F.col("word").alias("key"), groups("word").alias("tokens")), known.select(F.col("alias").alias("key"), groups("alias").alias("tokens")), min(min_word, min_run))
    pairs = pairs.join(known, pairs["right_key"] == known["alias"]).where(F.col("jaccard") >= F.when(F.col("several"), min_run).otherwise(min_word))
    order = F.struct("jaccard", (-F.col("several").cast("int")).alias("single"), F.length("alias").alias("length"), "alias")
    return pairs.groupBy(F.col("left_key").alias("word")).agg(F.max_by("core", order).alias("core"), F.max(F.col("is_word") & (F.col("alias") == F.col("left_key"))).alias("exact"))


def best_entry(sets: DataFrame, names: DataFrame, min_name: float) -> DataFrame:
    """(key, label): the entry (label, core) most similar to each set (key, core); the smaller label on a tie."""
    text = F.array_join("core", " ")
    kinds = sets.select(text.alias("key"), F.col("core").alias("tokens"))
    pairs = similar_sets(kinds, names.select(text.alias("key"), F.col("core").alias("tokens")), min_name)
    labels = names.groupBy(text.alias("right_key")).agg(F.min("label").alias("label"))
    found = pairs.join(labels, "right_key").groupBy("left_key").agg(F.max_by("label", F.struct("jaccard", (-F.col("label")).alias("l"))).alias("label"))
    return sets.select("key", text.alias("left_key")).join(found, "left_key").select("key", "label")


def map_values(
    values: DataFrame, value: str, entries: DataFrame, label: str, name: str, min_word: float = MIN_WORD, min_run: float = MIN_RUN, min_name: float = MIN_NAME
) -> DataFrame:
    """(value, label): for each distinct typed value that isn't blank the label of the most similar entry, else -1.

    A value as similar to two entries gets the smaller label.  Rows may repeat a
    value any number of times: each distinct value, and of these each distinct
    sequence of plain words, is matched once.  Null and blank values give no row; an
    empty list maps all to -1.  Entries with a null or blank name or a null label
    are ignored; of entries with the same words the smallest label counts.
    """
    folded = _udf("string", fold)
    typed = values.select(F.col(value).alias("value")).where(F.regexp_replace("value", r"^\s+|\s+$", "") != "").distinct()
    typed = cut(typed.withColumn("key", folded("value")), "typed")
    refs = entries.select(F.col(label).cast("int").alias("label"), F.col(name).alias("raw"), folded(F.col(name)).alias("name")).where("label is not null and name <> ''")
    refs = cut(refs.groupBy("name").agg(F.min("label").alias("label"), F.min("raw").alias("raw")), "entries")
    light = cut(light_words(refs), "light")
    known = cut(alias_table(refs, light), "alias")
    core = refs.select("label", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).join(light, "word", "left_anti").groupBy("label").agg(F.sort_array(F.collect_set("word")).alias("core"))
    core = cut(core, "core")

    keys = typed.select("key").distinct().where("key <> ''").select("key", F.split("key", " ").alias("words"))
    words = keys.select(F.explode("words").alias("word")).distinct()
    meant = cut(best_alias(words, known, min_word, min_run), "meant")

    # Words in their order, each with what it stands for; a number behind an unknown word belongs to it.
    each = keys.select("key", F.posexplode("words").alias("at", "word")).join(meant, "word", "left")
    each = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word", "core", "exact"))).alias("w"))
    digits = lambda x: x["word"].rlike("^[0-9]")

    def sense(x: Column, i: Column) -> Column:
        before = F.try_element_at("w", F.greatest(i, F.lit(1)))
        unknown = F.when(i == 0, "").when(before["core"].isNull() | digits(before), before["word"])
        bound = digits(x) & unknown.isNotNull()
        return F.when(bound, F.array(F.concat(F.lit("?"), unknown, F.lit("-"), x["word"]))).otherwise(F.coalesce(x["core"], F.array(F.concat(F.lit("?"), x["word"]))))

    each = each.select("key", "w", F.transform("w", sense).alias("s"))
    each = cut(each.select("key", F.transform("w", lambda x: x["word"]).alias("w"), "s", F.forall("w", lambda x: F.coalesce(x["exact"], F.lit(False))).alias("exact"), F.array_sort(F.array_distinct(F.flatten("s"))).alias("m")), "read")

    is_known = lambda t: ~t.startswith("?")
    complete = core.select(F.array_join("core", " ").alias("named"), F.lit(True).alias("whole")).distinct()
    extra = each.select("key", F.explode(F.filter("m", lambda t: t.startswith("?"))).alias("token"), F.array_join(F.filter("m", is_known), " ").alias("named"))
    extra = cut(extra.join(complete, "named", "left").select("key", "token", F.coalesce("whole", F.lit(False)).alias("whole")), "extra")
    notes = extra.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("k")).where("2 * k > n")
    drop = extra.join(notes.select("token"), "token", "left_semi").groupBy("key").agg(F.collect_set("token").alias("drop"))
    nothing = F.array().cast("array<string>")
    each = each.join(drop, "key", "left").select("key", "w", "s", "m", "exact", F.coalesce("drop", nothing).alias("drop"))
    each = cut(each.select("key", "exact", F.array_except("m", "drop").alias("core"), F.zip_with("w", "s", lambda w, s: F.when(F.arrays_overlap(s, "drop"), "").otherwise(w)).alias("left")), "cores")

    first = cut(best_entry(each.where("size(core) > 0").select("key", "core"), core, min_name), "first")
    rest = each.where("not exact").join(first, "key", "left_anti").select("key", F.array_join("left", "").alias("word")).where("word <> ''")
    run = best_alias(rest.select("word").distinct(), known.where("several"), min_run, min_run)
    second = best_entry(rest.join(run, "word").where("size(core) > 0").select("key", F.array_sort("core").alias("core")), core, min_name)
    best = first.unionByName(second)
    return typed.join(best, "key", "left").select("value", F.coalesce("label", F.lit(-1)).alias("label"))
