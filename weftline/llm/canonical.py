"""Texts that look alike brought to one form: only unstable segments are normalized and spliced back.

Which characters are look-alikes comes from the public Unicode table of confusable characters, as the ICU library that
Spark ships with holds it: a letter of another script is taken for the ASCII letter of the same case with the same
skeleton. A short list of fixed values holds what that table lacks, and is all where ICU cannot be reached.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import cut, ship

# Letters of other scripts that look like a Latin one, each followed by it.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ѵv ӀI ԚQ ԜW ҮY"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj"
ARMENIAN = "ՕO օo ՏS սu հh ոn ցg"
LATIN = "ɡg ɑa"
#: Signs that look like an ASCII one.
SIGNS = "‐- ‑- ﹣- −-"
ALIKE = {x[0]: x[1] for x in f"{CYRILLIC} {GREEK} {ARMENIAN} {LATIN} {SIGNS}".split()}
#: Compatibility forms that show the same sign (others, such as superscripts and circled digits, look different).
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: What shows nothing though its category is not that of a format character.
BLANKS_OF_NO_WIDTH = "͏ᅟᅠ឴឵ㅤﾠ"

#: A maximal run of what is not plain ASCII, with the character before it, to which a mark may belong.
SEGMENT = re.compile(r"[\x20-\x7e]?[^\n\t\x20-\x7e]+")
PLAIN = re.compile(r"[\n\t\x20-\x7e]*")


class Forms:
    """What characters show, for a table of look-alikes; remembered for each character and segment."""

    def __init__(self, alike: dict[str, str] = ALIKE):
        self.alike = alike
        self.shown = lru_cache(maxsize=None)(self._shown)
        self.unstable = lru_cache(maxsize=None)(self._unstable)
        self.segment = lru_cache(maxsize=65536)(self._segment)

    def _shown(self, ch: str) -> str:
        """What a character shows, in canonical decomposition; itself if it is stable."""
        cat, cp = unicodedata.category(ch), ord(ch)
        if ch in "\n\tſ":
            return ch
        if ch in self.alike:
            return self.alike[ch]
        if cat in ("Zl", "Zp") or ch == "\x85":
            return "\n"
        if cat == "Zs":
            return " "
        if cat in ("Cf", "Cc") or ch in BLANKS_OF_NO_WIDTH or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
            return ""
        d = unicodedata.decomposition(ch)
        if d.startswith("<"):
            tag, *parts = d.split()
            if tag in SAME_LOOK and not 0x2100 <= cp <= 0x214F:
                return "".join(self.shown(chr(int(p, 16))) for p in parts)
            return ch
        if d or 0xAC00 <= cp <= 0xD7A3:
            return "".join(self.alike.get(x, x) for x in unicodedata.normalize("NFD", ch))
        return ch

    def _unstable(self, ch: str) -> bool:
        """Whether a character may change, or may join with the one before it (the quick check says No or Maybe)."""
        if unicodedata.category(ch) in ("Mn", "Mc", "Me") or 0x1100 <= ord(ch) <= 0x11FF:
            return True
        return unicodedata.normalize("NFC", self.shown(ch)) != ch

    def _segment(self, s: str) -> str:
        """Runs of unstable characters, each with the one stable character before it, normalized and spliced back."""
        out, at, n = [], 0, len(s)
        while at < n:
            if not self.unstable(s[at]):
                at += 1
                continue
            end = at
            while end < n and self.unstable(s[end]):
                end += 1
            begin = at - 1 if at else at
            out.append(s[:begin] + unicodedata.normalize("NFC", "".join(map(self.shown, s[begin:end]))))
            s, at, n = s[end:], 0, n - end
        return "".join(out) + s

    def canonical(self, text: str) -> str:
        """The form shared by all texts that look the same; letter case, accents, digits and punctuation stay as seen."""
        return text if PLAIN.fullmatch(text) else SEGMENT.sub(lambda m: self.segment(m[0]), text)


canonical = Forms().canonical


@lru_cache(maxsize=4)
def _confusable(jvm) -> dict[str, str]:
    """Letters and the ASCII letter of the same case they can be mistaken for, from ICU's table; empty without ICU."""
    letters = [chr(c) for c in range(0x80, 0x30000) if unicodedata.category(chr(c)) in ("Lu", "Ll") and unicodedata.bidirectional(chr(c)) == "L" and unicodedata.decomposition(chr(c))[:8] in ("", "<compat>")]
    lisu = [chr(c) for c in range(0xA4D0, 0xA4F8)]  # letters without case that look like capitals
    try:
        check = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        plain = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B))]
        # A line feed maps to itself and divides the answers.
        of = dict(zip([*plain, *letters, *lisu], check.getSkeleton("\n".join([*plain, *letters, *lisu])).split("\n")))
    except Exception:  # noqa: BLE001 - another kind of session, or a Spark without ICU
        return {}
    looks: dict[tuple[str, bool], str] = {(of[a], a.isupper()): a for a in plain}
    upper = {ch: True for ch in lisu} | {ch: unicodedata.category(ch) == "Lu" for ch in letters}
    return {ch: looks[of[ch], up] for ch, up in upper.items() if (of[ch], up) in looks}


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Every look-alike letter and sign with the ASCII one it is taken for."""
    context = getattr(spark, "_sc", None)
    return {**(_confusable(context._jvm) if context is not None else {}), **ALIKE}


def _run(alike: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Forms(alike).canonical
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([form(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text", "canonical"])

    return run


def canonical_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text, canonical) of every row with a text, the empty text included; null texts are left out.

    Blanks of any kind become a space each, line separators a line feed; characters that show nothing are dropped;
    full-width, ligature and font forms and look-alike letters become the plain ones; accents are composed. Texts of
    plain ASCII are stable and never leave the JVM. Markup and entities are not decoded. Whole texts are read.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id is not null and text is not null")
    # $ would also match before a final line end, hence the negated class.
    odd = F.col("text").rlike(r"[^\n\t\x20-\x7e]")
    return src.filter(~odd).withColumn("canonical", F.col("text")).unionByName(src.filter(odd).mapInArrow(_run(look_alikes(docs.sparkSession)), "doc_id long, text string, canonical string"))


def alike_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b): documents whose texts differ as stored but have one canonical form; doc_a < doc_b.

    Stored variants of a form are paired first and documents joined to them after, so equal texts, however many, never
    meet each other. Texts are compared by SHA-256.
    """
    t = cut(canonical_texts(docs, key, text).select("doc_id", F.sha2("text", 256).alias("r"), F.sha2("canonical", 256).alias("c")))
    variants = t.select("c", "r").distinct()
    several = variants.groupBy("c").count().filter(F.col("count") > 1).select("c")
    held = variants.join(several, "c", "left_semi")
    two = held.withColumnRenamed("r", "r1").join(held.withColumnRenamed("r", "r2"), "c").filter("r1 < r2").select("r1", "r2")
    a, b = t.select(F.col("r").alias("r1"), F.col("doc_id").alias("x")), t.select(F.col("r").alias("r2"), F.col("doc_id").alias("y"))
    return two.join(a, "r1").join(b, "r2").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def alike_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, class_id, n_docs, n_texts): every document whose form is stored in several texts; no pairs are made.

    A class is named by its smallest document; equal texts count as one of its texts.
    """
    t = cut(canonical_texts(docs, key, text).select("doc_id", F.sha2("text", 256).alias("r"), F.sha2("canonical", 256).alias("c")))
    once = t.groupBy("c", "r").agg(F.count("*").alias("n"), F.min("doc_id").alias("m"))
    several = once.groupBy("c").agg(F.min("m").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_texts")).filter("n_texts > 1")
    return t.join(several, "c").select("doc_id", "class_id", "n_docs", "n_texts")
