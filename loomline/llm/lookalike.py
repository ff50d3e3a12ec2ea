"""One consistent form for text that looks the same.

Every letter belongs to a look class: the letters of Latin, Greek, Cyrillic and Armenian that are drawn
alike. A class is written in each script that has a letter of this look, so a token's resolved script
set is the intersection over its letters. One script left: the token is spelt in it. Several left (a
token made of shared looks only, a whole-script confusable): the script that decided most tokens of the
text. None left (a mixed token): letters that are drawn nearly alike (``v`` and Greek nu) may stand for
each other as well; of the scripts left then, the one of most tokens of the text spells the token.
Letters that are nearly alike are so only in mixed tokens: a Greek word is not a Latin one because of
them. Where no script is left even so, every letter takes its class's first spelling. Full-width and
other compatibility letters, joined letters, kinds of space, invisible characters and split accents are
brought to one form too.

But for mixed tokens the result depends on the looks alone, so two texts get one form if and only if
they look the same. Case, accents, digits, punctuation, line breaks and the number of spaces stay.

Defined cases. Null texts are left out (pairs) or stay null (texts). Empty texts are a form of their
own. Identical texts are no pair; repeated rows of one document count once.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.runtime import cut

# Letters drawn alike, Latin first, then (where there is one) Cyrillic and Greek.
LIKE_LATIN_CYRILLIC = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "Q": "Ԛ", "S": "Ѕ", "T": "Т", "W": "Ԝ", "X": "Х", "Y": "Ү",
}
LIKE_LATIN_GREEK = {
    "o": "ο", "c": "ϲ", "j": "ϳ",
    "A": "Α", "B": "Β", "E": "Ε", "Z": "Ζ", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "Y": "Υ", "X": "Χ",
}
LIKE_LATIN_ARMENIAN = {"o": "օ", "O": "Օ"}
LIKE_GREEK_CYRILLIC = {"Γ": "Г", "Π": "П", "Φ": "Ф"}
ALSO_CYRILLIC = {"У": "Y"}
#: Letters of one script that are drawn as another of it.
WITHIN_LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s"}
#: Letters drawn nearly alike, Latin, Greek, Cyrillic, Armenian; a blank where a script has none.
NEAR = ["aα  ", "bβь ", "eε  ", "g  ց", "h нհ", "iι  ", "j  յ", "kκк ", "m м ", "nηпո", "oσ  ", "pρ  ", "q  զ", "r г ", "tτт ", "uυ ս", "vνѵ ", "wωш ", "xχ  ", "yγ  ", "S  Տ", "U  Ս", "V Ѵ "]

LATIN, GREEK, CYRILLIC, ARMENIAN = "Latin", "Greek", "Cyrillic", "ARMENIAN"
SCRIPTS = (LATIN, GREEK, CYRILLIC, ARMENIAN)
TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
#: Letters of the other scripts that no Latin letter looks like, as far as looks still hold any.
OTHER_SCRIPT = re.compile("[\u0370-\u058f\u1f00-\u1fff]")
PAIRS = "doc_id_a bigint, doc_id_b bigint"
#: Documents of one look beyond which its pairs are made in several tasks.
LOOK_ROWS = 2000


@cache
def tables() -> tuple[dict, dict, dict, dict]:
    """Character folding, look classes, scripts per class, spelling per script and class."""
    fold: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        if cp < 0x80:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp == 0x34F or 0xE0100 <= cp <= 0xE01EF:
            fold[ch] = ""
        elif cat == "Zs":
            fold[ch] = " "
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>", "<font>")) or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F:
            fold[ch] = unicodedata.normalize("NFKC", ch)
    fold |= {"\t": " "} | WITHIN_LATIN
    look = {c: l for l, c in (*LIKE_LATIN_CYRILLIC.items(), *LIKE_LATIN_GREEK.items(), *LIKE_LATIN_ARMENIAN.items(), *LIKE_GREEK_CYRILLIC.items())} | {c: l for c, l in ALSO_CYRILLIC.items()}
    scripts: dict[str, set[str]] = {}
    spelt: dict[str, dict[int, str]] = {GREEK: {}, CYRILLIC: {}, ARMENIAN: {}}
    for like, mine, other in ((LIKE_LATIN_CYRILLIC, LATIN, CYRILLIC), (LIKE_LATIN_GREEK, LATIN, GREEK), (LIKE_LATIN_ARMENIAN, LATIN, ARMENIAN), (LIKE_GREEK_CYRILLIC, GREEK, CYRILLIC)):
        for l, c in like.items():
            scripts.setdefault(l, {mine}).add(other)
            spelt[other][ord(l)] = c
    return fold, look, {k: frozenset(v) for k, v in scripts.items()}, spelt


@cache
def scripts_of(ch: str) -> frozenset[str]:
    shared = tables()[2].get(ch)
    if shared:
        return shared
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return frozenset([LATIN])
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return frozenset([GREEK])
    if 0x400 <= cp < 0x530:
        return frozenset([CYRILLIC])
    return frozenset([unicodedata.name(ch, "?").split(" ")[0]])


@cache
def near() -> dict[str, dict[str, str]]:
    """Look -> script -> the nearly alike look that this script can write."""
    look, out = tables()[1], {}
    for row in NEAR:
        kin = [look.get(c, c) for c in row if c != " "]
        for x in kin:
            for y in kin:
                if x != y:
                    for script in sorted(scripts_of(y)):
                        if script not in scripts_of(x):
                            out.setdefault(x, {}).setdefault(script, y)
    return out


def replaced(text: str, by: dict[str, str]) -> str:
    """Every character of ``by`` replaced; a text holds few of them, so each is one fast pass."""
    for ch in set(text) & by.keys():
        text = text.replace(ch, by[ch])
    return text


def folded(text: str) -> str:
    """One character for each kind of space and width, no invisible ones, letters and accents apart."""
    return unicodedata.normalize("NFD", replaced(text, tables()[0]))


def skeleton(text: str) -> str:
    """Looks: decomposed, every letter by the first spelling of its class."""
    if text.isascii():
        return text.replace("\t", " ")
    return replaced(folded(text), tables()[1])


def resolved(token: str, nearly: bool = False) -> frozenset[str]:
    """Scripts that can write every letter of a token of looks; ``nearly``: or a letter drawn nearly alike."""
    out: frozenset[str] | None = None
    for ch in token:
        if "̀" <= ch <= "ͯ":
            continue
        s = scripts_of(ch)
        if nearly:
            s = s | near().get(ch, {}).keys()
        out = s if out is None else out & s
        if not out:
            break
    return out or frozenset()


def choose(can: frozenset[str], votes: Counter) -> str:
    """The script of most tokens of the text, Latin before others."""
    return max(sorted(can, reverse=True), key=lambda s: (votes[s], s == LATIN))


def respelt(token: str, script: str) -> str:
    """Looks of a mixed token with every letter that ``script`` lacks replaced by the nearly alike one it has."""
    return "".join(c if script in scripts_of(c) or script not in near().get(c, {}) else near()[c][script] for c in token)


def normal(text: str, by_text: bool = True) -> str:
    """The consistent form. ``by_text`` false: tokens that several scripts could write are Latin if that is one of them."""
    looks = skeleton(text)
    if not OTHER_SCRIPT.search(looks):
        return unicodedata.normalize("NFC", looks)
    tokens = Counter(TOKEN.findall(looks))
    seen = {t: resolved(t) for t in tokens}
    if () in map(tuple, seen.values()):
        votes = Counter({s: sum(n for t, n in tokens.items() if seen[t] == {s}) for s in SCRIPTS}) if by_text else Counter()
        mended = {t: respelt(t, choose(can, votes)) for t in tokens if not seen[t] and (can := resolved(t, True))}
        looks = TOKEN.sub(lambda m: mended.get(m.group(), m.group()), looks)
        tokens = Counter(TOKEN.findall(looks))
        seen = {t: resolved(t) for t in tokens}
    spelt = tables()[3]
    votes = Counter({s: sum(n for t, n in tokens.items() if seen[t] == {s}) for s in SCRIPTS})
    if any(votes[s] for s in spelt):
        script = {t: choose(can, votes if by_text else Counter()) for t, can in seen.items() if can}
        looks = TOKEN.sub(lambda m: m.group().translate(spelt.get(script.get(m.group()), {})), looks)
    return unicodedata.normalize("NFC", looks)


def token_report(text: str) -> tuple[int, int]:
    """Tokens whose letters mix scripts, and tokens wholly in another script's look-alikes."""
    look = tables()[1]
    t = folded(text)
    mixed = whole = 0
    for m in TOKEN.finditer(t):
        own = {script_by_code(c) for c in m.group() if not "̀" <= c <= "ͯ"}
        if len(own) > 1:
            mixed += 1
        elif own & {GREEK, CYRILLIC, ARMENIAN} and LATIN in resolved(replaced(m.group(), look)):
            whole += 1
    return mixed, whole


@cache
def script_by_code(ch: str) -> str:
    cp = ord(ch)
    return GREEK if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000 else CYRILLIC if 0x400 <= cp < 0x530 else ARMENIAN if 0x530 <= cp < 0x590 else LATIN if cp < 0x250 or 0x1E00 <= cp < 0x1F00 else "other"


def normalized(documents: DataFrame) -> DataFrame:
    """doc_id, the consistent form, whether it differs, and the numbers of mixed and whole-script look-alike tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(None, None, None, None) if t is None else (n := normal(t), n != t, *((0, 0) if t.isascii() else token_report(t))) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "normal_text": [o[0] for o in out], "changed": pd.array([o[1] for o in out], "boolean"), "mixed_tokens": pd.array([o[2] for o in out], "Int32"), "whole_script_tokens": pd.array([o[3] for o in out], "Int32")})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, normal_text string, changed boolean, mixed_tokens int, whole_script_tokens int")


def looks_of(documents: DataFrame) -> DataFrame:
    """doc_id, 128-bit hashes of the consistent form (look) and of the text as it is (as_is), each once."""
    @F.pandas_udf("string")
    def look(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh3_128_hexdigest(normal(t).encode("utf-8", "surrogatepass")))

    return documents.where("doc_id is not null and text is not null").select("doc_id", look("text").alias("look"), F.md5("text").alias("as_is")).distinct()


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """Pairs of documents whose texts differ as strings and look the same.

    Documents meet by a 128-bit hash of their form; looks with one text only are dropped before, and
    looks with many documents are split into salted parts.
    """
    keyed = cut(looks_of(documents))
    looks = keyed.groupBy("look").agg(F.min("as_is").alias("x"), F.max("as_is").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    rows = keyed.join(looks.select("look", F.ceil(F.col("n") / LOOK_ROWS).cast("int").alias("parts")), "look")
    a = rows.select("look", F.col("doc_id").alias("doc_id_a"), F.col("as_is").alias("text_a"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    b = rows.select("look", F.col("doc_id").alias("doc_id_b"), F.col("as_is").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["look", "part"]).where("doc_id_a < doc_id_b and text_a <> text_b").select("doc_id_a", "doc_id_b")


def look_classes(documents: DataFrame) -> DataFrame:
    """One row per document: its look class (the smallest doc_id of the look), and the class's documents and different texts."""
    rows = cut(looks_of(documents))
    sizes = rows.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("as_is").alias("n_texts"))
    return rows.join(sizes, "look").groupBy("doc_id", "class_id").agg(F.max("n_docs").alias("n_docs"), F.max("n_texts").alias("n_texts"))
