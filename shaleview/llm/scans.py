"""Problem 6: noise in text from scanned pages.

A symmetric-delete index over the corpus's frequency lexicon proposes corrections: every attested word is stored under the
forms of its first letters with up to two of them deleted, a suspicious word looks its own deletions up, and only candidates
that are explained by confusion pairs (a letter or two read as another) are kept. A weighted distance adds what each
confusion pair weighs: the less often it explains misread words of the corpus, the more. Every occurrence is then judged by
the ratio of frequencies, the weight, and the counts of word pairs with its neighbours. Words split at a line end are
joined unless the parts form a compound; headers are lines at a page's edge that recur, up to misreadings, on other
pages of the document; page numbers are told by their form.

All thresholds are ratios of counts, so they mean the same in a corpus of any size.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, written

# What a letter is misread as.
CONFUSIONS = {"a": ["o"], "u": ["ii"], "e": ["c"], "o": ["0"], "l": ["1"], "i": ["l", "1"], "t": ["f"], "d": ["cl"], "h": ["b"], "m": ["rn"], "w": ["vv"], "s": ["5"], "g": ["9"], "b": ["6"]}
PAGE_NUMBER = r"(?:page|pg\.?|seite|p\.)\s*[0-9il]{1,4}(?:\s*(?:of|/|von)\s*[0-9il]{1,4})?|\[\s*\d{1,4}\s*\]|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}\s*/\s*\d{1,4}|\d{1,4}"
NUMBER_LINE = re.compile(rf"^\W*?(?:{PAGE_NUMBER})\s*$", re.I)
NUMBER_END = re.compile(rf"(?:\s{{2,}}|\t|\s*[|·]\s*)(?:{PAGE_NUMBER})\s*$", re.I)
NUMBER_START = re.compile(rf"^\s*(?:{PAGE_NUMBER})(?:\s{{2,}}|\t|\s*[|·]\s*)", re.I)
HYPHEN = re.compile(r"([^\W\d_]+(?:[0-9][^\W_]*)?)[-‐‑­][ \t]*\n[ \t]*([^\W_]+)")
WORD = re.compile(r"[^\W_]+")
PREFIX = 10  # letters of a word that the deletions are made of
STRONG, SHORT, WEAK = 3.0, 5.6, 1.58  # bits by which the corrected word must be likelier: for most words, for words under four letters, beside word pairs that speak for it


def is_page(text: Column) -> Column:
    """Whether the lines look like a page's: five or more, most of them of a column's width."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines) - 1
    wide = F.size(F.filter(F.slice(lines, 1, F.greatest(n, F.lit(0))), lambda x: F.length(x).between(35, 90)))
    return (n >= 4) & (wide >= 0.6 * n)


@lru_cache(maxsize=1 << 16)
def collapsed(word: str) -> str:
    """The word with pairs of letters that are read for one put together."""
    return word.replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w")


def deletions(word: str, most: int = 2) -> list[str]:
    """All forms of the first letters of the word, as it is and collapsed, with up to `most` letters deleted; at least one stays."""
    forms = {word[:PREFIX], collapsed(word)[:PREFIX]}
    return list({"".join(c for i, c in enumerate(w) if i not in out) for w in forms for n in range(min(most, max(0, len(w) - 1)) + 1) for out in combinations(range(len(w)), n)})


def confusions(clean: str, seen: str) -> list[str]:
    """The fewest confusion pairs by which `clean` was misread as `seen`, as "clean>seen"; none if they don't explain it or both are equal."""
    best: dict[int, tuple[str, ...]] = {0: ()}
    for c in clean:
        new: dict[int, tuple[str, ...]] = {}
        for j, path in best.items():
            for r in (c, *CONFUSIONS.get(c, ())):
                if seen.startswith(r, j):
                    longer = path if r == c else (*path, f"{c}>{r}")
                    if j + len(r) not in new or len(longer) < len(new[j + len(r)]):
                        new[j + len(r)] = longer
        best = new
    return list(best.get(len(seen), ()))


def skeleton(line: str) -> str:
    """The letters of a line such that misreadings fall together."""
    s = "".join(c for c in line.lower() if c.isalnum())
    return re.sub("[il1]", "i", collapsed(s).translate(str.maketrans("a0cfb5", "ooeths")))


def edges(text: str) -> list[tuple[int, str, bool, bool]]:
    """(line number, header text, is a page number alone, has one beside it) of the lines at top and foot."""
    lines = [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip())]
    out = {}
    for way in (lines, lines[::-1]):
        header = False
        for i, s in way:  # only an unbroken row from the very edge is layout: numbers and at most one other line
            if NUMBER_LINE.match(s):
                out[i] = (i, "", True, False)
                continue
            if header:
                break
            core = NUMBER_START.sub("", NUMBER_END.sub("", s))
            out[i] = (i, core, False, core != s)
            header = True
    return [out[i] for i in sorted(out)]


def prose(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'prose' and text is not null and block_id is not null").select("block_id", "doc_id", "text").distinct()


def tokens(text: Column) -> Column:
    """Lower-case words that aren't numbers."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.rlike(r"^\p{N}+$"))


def worded(b: DataFrame) -> DataFrame:
    """Rows (block_id, doc_id, words, plain): the words of a text with line-end hyphens joined, and without the words at such hyphens (null where there are none)."""
    hyphen = r"(\p{L}+(?:[0-9][\p{L}\p{N}]*)?)[-‐‑\u00ad][ \t]*\n[ \t]*([\p{L}\p{N}]+)"
    broken = F.col("text").rlike("[-‐‑\\u00ad][ \\t]*\n")  # quick to tell, so that few texts are matched for more
    words = tokens(F.when(broken, F.regexp_replace("text", hyphen, "$1$2")).otherwise(F.col("text")))
    return b.select("block_id", "doc_id", words.alias("words"), F.when(broken, tokens(F.regexp_replace("text", hyphen, " "))).alias("plain"))


def lexicon(words: DataFrame) -> DataFrame:
    """Rows (w, n): every word of the prose blocks with its count."""
    return words.select(F.explode(F.coalesce("plain", "words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def corrections(pages: DataFrame, lex: DataFrame) -> DataFrame:
    """Rows (w, n, to, n_to, pairs, weight): misread words of the pages with what each may have been.

    pages: rows of worded(). weight: bits beyond the commonest confusion, by how often each pair is the only explanation of a word.
    A corrected word is likelier by WEAK bits at least, so it is attested three times or more.
    """
    seen = pages.select(F.explode(F.array_distinct("words")).alias("w")).distinct()
    keys = F.udf(deletions, "array<string>", useArrow=True)
    explained = F.udf(confusions, "array<string>", useArrow=True)
    words = written(seen.where("length(w) >= 2").join(lex, "w", "left").select("w", F.coalesce("n", F.lit(1)).alias("n")), "p6-words")
    probe = words.select("w", "n", F.explode(keys("w")).alias("k")).select("w", "n", F.xxhash64("k").alias("key"))
    index = lex.where("n >= 3 and length(w) >= 2 and not w rlike '[0-9]'").select(F.col("w").alias("to"), F.col("n").alias("n_to"), F.explode(keys("w")).alias("k")).select("to", "n_to", F.xxhash64("k").alias("key"))
    # exploded keys are far larger than the engine's estimate of them: never broadcast
    pairs = probe.hint("merge").join(index, "key").where((F.col("w") != F.col("to")) & (F.col("n_to") >= 3 * F.col("n")) & (F.abs(F.length("w") - F.length("to")) <= 4)).select("w", "n", "to", "n_to").distinct()
    fixes = written(pairs.withColumn("pairs", explained("to", "w")).where("size(pairs) > 0"), "p6-explained")
    alone = fixes.groupBy("w").agg(F.count("*").alias("c"), F.first("pairs").alias("pairs")).where("c = 1 and size(pairs) = 1")
    counts = {r.p: r["count"] for r in alone.groupBy(F.col("pairs")[0].alias("p")).count().collect()}  # a row a confusion pair: CONFUSIONS has under thirty
    total = sum(counts.values()) + len(counts) + 1
    bits = {f"{c}>{r}": math.log2(total / (counts.get(f"{c}>{r}", 0) + 1)) for c, rs in CONFUSIONS.items() for r in rs}
    table, least = F.create_map(*[F.lit(x) for kv in bits.items() for x in kv]), min(bits.values())
    weight = F.aggregate("pairs", F.lit(0.0), lambda acc, x: acc + table[x]) - least
    return fixes.withColumn("weight", weight)


def occurrences(pages: DataFrame) -> DataFrame:
    """Rows (block_id, before, w, after) of every word of the pages; "" at either end."""
    at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    some = pages.select("block_id", "words", F.posexplode("words").alias("i", "w"))
    return some.select("block_id", F.when(F.col("i") > 0, at(F.greatest(F.col("i") - 1, F.lit(0)))).otherwise("").alias("before"), "w", at(F.col("i") + 1).alias("after"))


def word_pairs(words: DataFrame) -> DataFrame:
    """Rows (pair, n): hashes of neighbouring words with their counts."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1)))
    return words.where("size(words) > 1").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def judged(words: DataFrame, pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """Rows (block_id, before, w, to): occurrences that are misread, with the repair that fits them best.

    Frequencies and weight make the score of a correction. If the word pairs of the neighbours with the word as it
    stands are clearly more frequent than with the correction, it stays; if those with the correction are more, WEAK bits will do.
    """
    occ = occurrences(pages).join(fixes, "w")
    key = lambda a, b: F.xxhash64(a, b)
    occ = written(occ.select("*", key("before", "w").alias("bw"), key("w", "after").alias("wa"), key("before", "to").alias("bt"), key("to", "after").alias("ta")), "p6-suspicious")
    needed = occ.select(F.explode(F.array("bw", "wa", "bt", "ta")).alias("pair")).distinct()
    two = written(word_pairs(words).join(needed, "pair", "left_semi"), "p6-pairs")
    for c in ("bw", "wa", "bt", "ta"):
        occ = occ.join(two.select(F.col("pair").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own, fixed = zero("n_bw") + zero("n_wa"), zero("n_bt") + zero("n_ta")
    ratio = F.log2(F.col("n_to") / F.col("n"))
    score = ratio - F.col("weight")
    enough = (score >= F.when(F.length("w") < 4, SHORT).otherwise(STRONG)) & (own <= 2 * (fixed + 1)) | (ratio >= WEAK) & (F.length("w") >= 4) & (fixed >= own)
    return occ.where(enough).groupBy("block_id", "before", "w").agg(F.max_by("to", F.struct(F.log2(fixed + 1) + score, F.col("to"))).alias("to"))


EDGES = "array<struct<i:int,core:string,number:boolean,beside:boolean,sk:string>>"


def layout(pages: DataFrame) -> DataFrame:
    """Rows (block_id, i, header, number): lines at the edges of a page that are a running header or a page number."""

    @F.pandas_udf(EDGES)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"i": i, "core": core, "number": number, "beside": beside, "sk": skeleton(core)} for i, core, number, beside in edges(t)])

    e = written(pages.select("block_id", "doc_id", F.explode(found("text")).alias("e")).select("block_id", "doc_id", "e.*"), "p6-edges")
    again = e.where("length(sk) >= 8").groupBy("doc_id", "sk").agg(F.min("block_id").alias("lo"), F.max("block_id").alias("hi")).where("lo < hi").select("doc_id", "sk", F.lit(True).alias("again"))
    # a line that recurs nowhere in its document is a header too if most lines that end so are headers, in other documents
    tail = F.substring("sk", -12, 12)
    lines = e.where("length(sk) >= 8").join(again, ["doc_id", "sk"], "left").groupBy(tail.alias("tail"))
    tails = lines.agg(F.avg(F.coalesce("again", F.lit(False)).cast("int")).alias("share"), F.countDistinct("doc_id").alias("d")).where("share >= 0.5 and d >= 2").select("tail", F.lit(True).alias("usual"))
    marked = e.withColumn("tail", tail).join(again, ["doc_id", "sk"], "left").join(tails, "tail", "left")
    header = F.coalesce(F.col("again"), F.lit(False)) | F.coalesce(F.col("usual"), F.lit(False)) & ~F.col("core").rlike(r"[.;:,]$")
    return marked.select("block_id", "i", header.alias("header"), (F.col("number") | header & F.col("beside")).alias("number")).where("header or number")


def pages_of(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words of all prose blocks, words and texts of page blocks); documents with a block whose lines are a page's count as scanned, the flag is_scanned isn't relied on."""
    b = written(prose(blocks), "p6-prose")
    scanned = b.where(is_page(F.col("text"))).select("doc_id").distinct()
    pages = written(b.join(scanned, "doc_id", "left_semi").select("block_id", "doc_id", "text"), "p6-pages")
    words = written(worded(b).join(scanned.withColumn("scanned", F.lit(True)), "doc_id", "left"), "p6-worded")
    return words, pages, words.where("scanned")


def hyphen_pairs(pages: DataFrame) -> DataFrame:
    """Rows (block_id, a, b): the parts of words at a line-end hyphen."""
    parts = F.udf(lambda t: [f"{a} {b}".lower() for a, b in HYPHEN.findall(t)], "array<string>", useArrow=True)
    return pages.where("text rlike '[-‐‑­][ \\t]*\\n'").select("block_id", F.explode(parts("text")).alias("p")).select("block_id", F.split("p", " ")[0].alias("a"), F.split("p", " ")[1].alias("b"))


def splits(pages: DataFrame, lex: DataFrame) -> DataFrame:
    """Rows (block_id, a, b) of words that were split: joined they are attested, or a part is no word of its own.

    A part is a word of its own if it is attested three times as often as the two parts meet at a line end.
    """
    h = hyphen_pairs(pages)
    kinds = h.groupBy("a", "b").agg(F.count("*").alias("h"))
    n = lambda c: lex.select(F.col("w").alias(c), F.col("n").alias(f"n_{c}"))
    kinds = kinds.withColumn("j", F.concat("a", "b")).join(n("j"), "j", "left").join(n("a"), "a", "left").join(n("b"), "b", "left")
    own = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0)) >= 3 * F.col("h")
    return h.join(kinds.where(F.col("n_j").isNotNull() | ~own("a") | ~own("b")).select("a", "b"), ["a", "b"])


def noise(blocks: DataFrame) -> DataFrame:
    """Rows (block_id, noise_kind) of page blocks with noise.

    Null and empty texts and other block types have none; repeated rows count once. Documents count as scanned if their
    lines are a page's.
    """
    words, pages, ours = pages_of(blocks)
    lex = written(lexicon(words), "p6-lexicon")
    misread = judged(words, ours, corrections(ours, lex)).select("block_id").distinct()
    marks = written(layout(pages), "p6-layout")
    kind = lambda d, k: d.select("block_id", F.lit(k).alias("noise_kind"))
    return (kind(splits(pages, lex), "hyphenation").union(kind(misread, "characters"))
            .union(kind(marks.where("header"), "running_header")).union(kind(marks.where("number"), "page_number"))).distinct()


def repaired(blocks: DataFrame) -> DataFrame:
    """Rows (block_id, doc_id, paragraphs, continues): each page's text as paragraphs, without layout, with repaired words.

    continues: the last paragraph goes on in the next page block. Texts of other documents are left as they are.
    """
    words, pages, ours = pages_of(blocks)
    lex = written(lexicon(words), "p6-lexicon")
    best = judged(words, ours, corrections(ours, lex))
    gone = layout(pages).groupBy("block_id").agg(F.collect_set("i").alias("gone"))  # at most a page's lines
    whole = splits(pages, lex).groupBy("block_id").agg(F.collect_set(F.concat_ws(" ", "a", "b")).alias("whole"))
    done = best.groupBy("block_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "before", "w"), "to"))).alias("fix"))  # at most a page's words

    @F.pandas_udf("paragraphs array<string>, continues boolean")
    def mend(texts: pd.Series, gone: pd.Series, whole: pd.Series, fix: pd.Series) -> pd.DataFrame:
        out = [mended(t, set() if g is None else set(g), set() if w is None else set(w), {} if f is None else dict(f)) for t, g, w, f in zip(texts, gone, whole, fix)]
        return pd.DataFrame(out, columns=["paragraphs", "continues"])

    m = pages.join(gone, "block_id", "left").join(whole, "block_id", "left").join(done, "block_id", "left")
    return m.select("block_id", "doc_id", mend("text", "gone", "whole", "fix").alias("m")).select("block_id", "doc_id", "m.*")


def mended(text: str, gone: set[int], whole: set[str], fix: dict[str, str]) -> tuple[list[str], bool]:
    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    text = HYPHEN.sub(lambda m: m[1] + m[2] if f"{m[1]} {m[2]}".lower() in whole else f"{m[1]}-{m[2]}", text)
    before = [""]

    def word(m: re.Match) -> str:
        w = m[0].lower()
        new = fix.get(f"{before[0]} {w}")
        if not w.isdigit():
            before[0] = w
        return m[0] if new is None else new.upper() if m[0].isupper() and len(w) > 1 else new.title() if m[0][0].isupper() else new

    text = WORD.sub(word, text)
    paragraphs = [re.sub(r"\s*\n\s*", " ", p).strip() for p in re.split(r"\n\s*\n", text)]
    paragraphs = [p for p in paragraphs if p]
    return paragraphs, bool(paragraphs) and not re.search(r"[.!?:\"”)]$", paragraphs[-1])


def p6_found(spark, sf_dir) -> DataFrame:
    return noise(read(spark, sf_dir, "extracted_blocks"))


def p6_paragraphs(spark, sf_dir) -> DataFrame:
    """The repaired text of each page block."""
    r = repaired(read(spark, sf_dir, "extracted_blocks"))
    return r.select("block_id", F.concat_ws("\n\n", "paragraphs").alias("text"), "continues")


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
SQL: dict = {}
