"""Problem 1: one ordinary form for texts that look alike but differ in their characters.

Method: confusables skeleton. A text is decomposed, every character is replaced by its
prototype from the published table of look-alikes (Unicode confusables, some 17,000
characters, read from the ICU library that Spark ships with), and the result is decomposed
again; texts with equal skeletons look alike and form a class. The *ordinary member* of a
class is what a Latin or Thai keyboard gives, in typing order: a sign no keyboard has is
read as the key with the same prototype (and of the same kind, where several keys share
one), within the script its word is written in. A text is found if it is not the ordinary
member of its class.

Defined cases
    null text               -> null forms, in no class, never a finding
    empty text              -> itself; its class is that of the empty skeleton
    only invisible signs    -> the empty text (a finding)
    wholly foreign script   -> kept; only its invisible signs and spaces are mended
    very long text          -> processed whole
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Soft hyphen, joiners, direction marks, variation selectors, fillers: nothing of them is seen.
INVISIBLE = r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff]"
#: Code points the table is asked for: all that have prototypes lie below.
LAST_POINT = 0x20000
#: Scripts whose letters stand for Latin ones only within their word; letters of others are read one by one.
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN")
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>")
_invisible = re.compile(INVISIBLE)
_letters = re.compile(r"[^\W\d_ก-๛](?:[^\W\d_ก-๛]|[̀-ͯ])*")
_nikhahit = re.compile("([่-๋]?)ํ([่-๋]?)า")
_tone_first = re.compile("([่-์])([ัิ-ฺ็])")
#: A text in which this finds nothing is in the ordinary form whatever else it holds.
SUSPECT = (
    r"[^\x20-\x7eก-ฺ฿-๛À-ÖØ-öø-ÿ]"
    r"|เเ|ํ|[่-์][ัิ-ฺ็]|ๅ|ฤา|^ | $|  "
)


@lru_cache(maxsize=8192)
def _plain(ch: str) -> str:
    """The keyboard's sign for a compatibility form that looks the same; other signs stay."""
    if ch.isspace():
        return " " if unicodedata.category(ch) == "Zs" else ch
    if "฀" <= ch <= "໿":
        return ch
    shape = unicodedata.decomposition(ch)
    return unicodedata.normalize("NFKC", ch) if shape.startswith(SAME_LOOK) else ch


@lru_cache(maxsize=8192)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ")[0]


def _thai(text: str) -> str:
    text = text.replace("เเ", "แ").replace("ๅ", "า") if "ฤๅ" not in text and "ฦๅ" not in text else text.replace("เเ", "แ")
    text = text.replace("ฤา", "ฤๅ")
    text = _tone_first.sub(r"\2\1", text)
    return _nikhahit.sub(lambda m: m[1] + m[2] + "ำ", text)


def prototypes(spark: SparkSession) -> dict[str, str]:
    """The published look-alike table: every character whose prototype is another, with that prototype. One call for all of them."""
    points = [chr(c) for c in range(0x21, LAST_POINT) if not 0xD800 <= c < 0xE000]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(points)).split("\n")
    return {c: p for c, p in zip(points, skeletons, strict=True) if p != unicodedata.normalize("NFD", c)}


class Looks:
    """The look-alike table and what follows from it; small and of fixed size, so it travels to the workers."""

    _made: dict[str, Looks] = {}

    def __init__(self, table: dict[str, str]):
        self.table = table
        keys: dict[str, list[str]] = {}
        for c in map(chr, range(0x21, 0x7F)):
            keys.setdefault(table.get(c, c), []).append(c)
        self.latin, self.signs = {}, {}
        self.home: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
        for c, p in table.items():
            if c.isascii() or p not in keys:
                continue
            kind, script = unicodedata.category(c), _script(c)
            same = [k for k in keys[p] if unicodedata.category(k) == kind]
            key = same[0] if same else keys[p][0]
            if kind[0] == "L" and key.isalnum() and script in SCRIPTS:
                self.latin[c] = key
                if key.isalpha() and _plain(c) == c == unicodedata.normalize("NFC", c):
                    self.home[script].setdefault(key, c)
            elif (kind[0] == "L" and key.isalpha()) or (kind[0] != "L" and p == "-"):
                self.signs[c] = key
        self._signs = str.maketrans(self.signs)
        self._prototype = str.maketrans(table)

    @staticmethod
    def of(spark: SparkSession) -> Looks:
        """The table of a session, asked for once."""
        name = spark.sparkContext.applicationId
        if name not in Looks._made:
            Looks._made[name] = Looks(prototypes(spark))
        return Looks._made[name]

    def __reduce__(self):
        return Looks, (self.table,)

    def _foreign(self, word: str) -> str | None:
        """The script a word is surely written in: the one of its letters that resemble no Latin letter."""
        own = [s for c in word if c not in self.latin and (s := _script(c)) in SCRIPTS]
        return max(set(own), key=own.count) if own else None

    def _one_script(self, text: str) -> str:
        words = _letters.findall(text)
        at_home = {s for w in words if not re.search("[A-Za-z]", w) and (s := self._foreign(w))}

        def mend(m: re.Match) -> str:
            word = m.group()
            scripts = {_script(c) for c in word if c.isalpha()}
            if not scripts & set(SCRIPTS):
                return word
            if "LATIN" not in scripts:
                if self._foreign(word) or scripts <= at_home:
                    return word
                return "".join(self.latin.get(c, c) for c in word)
            home = self._foreign(word)
            latin = [c for c in word if _script(c) == "LATIN"]
            if home and all(c in self.home[home] for c in latin):
                return "".join(self.home[home].get(c, c) for c in word)
            return "".join(self.latin.get(c, c) for c in word)

        return _letters.sub(mend, text)

    def ordinary(self, text: str | None) -> str | None:
        """The member of the text's class that a keyboard gives; a fixed point of itself."""
        if text is None or (text.isascii() and "  " not in text and text == text.strip(" ")):
            return text
        text = _invisible.sub("", text)
        text = "".join(map(_plain, text)).translate(self._signs)
        text = self._one_script(unicodedata.normalize("NFD", text))
        text = unicodedata.normalize("NFC", _thai(unicodedata.normalize("NFC", text)))
        return re.sub(" {2,}", " ", text).strip(" ")

    def skeleton(self, text: str | None) -> str | None:
        """Decompose, replace by prototypes, decompose again. Equal skeletons look alike."""
        if text is None:
            return None
        text = unicodedata.normalize("NFD", "".join(map(_plain, _invisible.sub("", text))))
        text = unicodedata.normalize("NFD", _thai(text).translate(self._prototype))
        return re.sub(" {2,}", " ", text).strip(" ")

    def forms(self, texts: pd.Series) -> pd.DataFrame:
        """The ordinary form of every text and the skeleton of its class."""
        return pd.DataFrame({"ordinary": [self.ordinary(t) for t in texts], "skeleton": [self.skeleton(t) for t in texts]})

    def not_the_member(self, texts: pd.Series) -> pd.Series:
        """Of every text the ordinary member of its class, where it is another text of that class; else null."""

        def of(text: str | None) -> str | None:
            member = self.ordinary(text)
            return member if member != text and self.skeleton(member) == self.skeleton(text) else None

        return pd.Series([of(t) for t in texts], dtype=object)


def not_ordinary(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Rows whose text is not the ordinary member of its class, as (keys, ordinary). The JVM drops the plain ones before Python sees any."""
    looks = Looks.of(df.sparkSession)
    few = df.select(*keys, F.col(text).alias("_text")).filter(F.col("_text").rlike(SUSPECT))
    member = F.pandas_udf(lambda texts: looks.not_the_member(texts), "string")
    return few.select(*keys, member("_text").alias("ordinary")).filter("ordinary IS NOT NULL")


def look_alike_class(df: DataFrame, text: str) -> DataFrame:
    """Adds (ordinary, class_id) to every row; rows with equal class_id look alike.

    The class id is a digest of the skeleton, so a class of any size, a third of all
    rows included, is named without gathering or joining it.
    """
    looks = Looks.of(df.sparkSession)
    forms = F.pandas_udf(lambda texts: looks.forms(texts), "ordinary string, skeleton string")
    out = df.withColumn("_forms", forms(F.col(text)))
    return out.select(*[F.col(c) for c in df.columns], F.col("_forms.ordinary").alias("ordinary"), F.substring(F.sha2(F.col("_forms.skeleton"), 256), 1, 24).alias("class_id"))


def classes(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per class with more than one spelling: (class_id, ordinary, n_records, n_spellings). Spellings are told apart by digests; counts are combined map-side."""
    marked = look_alike_class(df, text).filter(F.col("class_id").isNotNull())
    spelled = marked.groupBy("class_id", F.xxhash64(text).alias("_t")).agg(F.countDistinct(key).alias("_n"), F.min("ordinary").alias("_o"))
    return spelled.groupBy("class_id").agg(F.min("_o").alias("ordinary"), F.sum("_n").alias("n_records"), F.count("*").alias("n_spellings")).filter("n_spellings > 1")
