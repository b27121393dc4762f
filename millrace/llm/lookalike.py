"""One form for texts that look the same.

Which letters have one look is read from the public table of confusable characters (Unicode's confusables, as ICU ships it in its
library, which Spark brings along). Letters of one look are a class; a class has a spelling in each script that has such a letter.
Over a token the scripts of its classes are intersected: what is left are the scripts in which the whole token can be spelt. A
token whose own scripts don't meet is mixed; one that is of one script but can be spelt in a script that comes before is a
whole-script confusable. Either is respelt in the first script left, Latin first; where none is left in the one that spells most
of it. So tokens of one look get one spelling, and ``suspects`` names them.

Kana that look like ideographs (and the sound mark like the number one) stand in words of all East Asian scripts together, so
their scripts always meet: there the neighbours decide. After that come the remaining forms: width, fonts, ligatures and
radicals, combining accents, invisible characters, kinds and widths of blanks.
"""

from __future__ import annotations

import functools
import glob
import hashlib
import os
import struct
import unicodedata
import zipfile
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_rows, spread
from millrace.sources.shared import write_shared

#: Scripts in the order in which a spelling is chosen; the others follow by name.
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")
#: Greek letters that stand for themselves when alone, as in formulas; in a token of several letters they count by their look.
ALONE = "αγικρσυωη"
# Radicals without a decomposition, and the ideographs of their look.
RADICALS = dict(zip("⺅⺆⺈⺉⺌⺍⺗⺘⺙⺛⺝⺡⺣⺤⺥⺨⺩⺪⺬⺭⺮⺰⺱⺲⺳⺴⺵⺶⺷⺸⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻰", "亻冂⺈刂小⺍⺗扌攵旡月氵灬爫⺥犭王疋示礻竹纟罒罓罒网罓羊⺷⺸耂⺺聿月臼艹艹艹虎衤西见角讠贝车辶辶辶阝钅長镸长门阜阝雨青韦页风飞食飠飠饣马骨鬼鱼鸟卤麦黄黾齐齿龙", strict=True))
# Letters that the public table keeps apart from the Latin letter of their look.
MORE_LOOKS = {"ĸ": "k", "У": "Y"}
# Latin letters that are drawn like one of the basic alphabet, and that letter.
DRAWN_ALIKE = {"ɡ": "g", "ɑ": "a", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z"}

_HIDDEN = r"\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️"
_KEEP = r"(?<=[\p{Extended_Pictographic}️\U0001F3FB-\U0001F3FF])‍(?=\p{Extended_Pictographic})"
_DROP = regex.compile(rf"(?!{_KEEP})[{_HIDDEN}]")
_EAST = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_TOKEN = regex.compile(rf"[[\p{{L}}\p{{M}}]--[{_EAST}\p{{Hangul}}\p{{Bopomofo}}]]+", regex.V1)
_KANA = regex.compile(r"[\p{Katakana}ー]")
_BLANKS = regex.compile(r"[^\S\n]+")
_LINES = regex.compile(r"\r\n?|[\x0b\x0c\x85\u2028\u2029]")
_AROUND = regex.compile(r" *\n *")
_TAGS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<vertical>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")


def confusables(path: str | None = None) -> dict[str, str]:
    """Each character of the public table to what it looks like. ``path`` is the table in ICU's binary form or a library with it; by default
    MILLRACE_CONFUSABLES, else the library among Spark's."""
    import pyspark

    homes = [os.path.join(h, "jars") for h in (*pyspark.__path__, os.environ.get("SPARK_HOME", ""))]
    path = path or os.environ.get("MILLRACE_CONFUSABLES") or next((f for h in homes for f in sorted(glob.glob(f"{h}/icu4j-*.jar"))), None)
    if not path:
        raise FileNotFoundError("set MILLRACE_CONFUSABLES to ICU's confusables.cfu or a library that has it")
    if path.endswith(".jar"):
        with zipfile.ZipFile(path) as library:
            raw = library.read(next(n for n in library.namelist() if n.endswith("confusables.cfu")))
    else:
        with open(path, "rb") as file:
            raw = file.read()
    end = ">" if raw[8] else "<"
    raw = raw[struct.unpack(end + "H", raw[:2])[0] :]
    keys, n_keys, values, n_values, texts, n_texts = struct.unpack(end + "9i", raw[:36])[3:]
    key, value = struct.unpack_from(f"{end}{n_keys}I", raw, keys), struct.unpack_from(f"{end}{n_values}H", raw, values)
    text = raw[texts : texts + 2 * n_texts].decode("utf-16-be" if end == ">" else "utf-16-le", "surrogatepass").encode("utf-16-be", "surrogatepass")
    out = {}
    for k, v in zip(key, value, strict=True):
        size = (k >> 24) + 1  # a single unit is the value itself, more are a place in the text
        out[chr(k & 0xFFFFFF)] = chr(v) if size == 1 else text[2 * v : 2 * (v + size)].decode("utf-16-be")
    return out


@functools.cache
def _script(letter: str) -> str | None:
    """The script of a letter, by its name; none for marks and what has no name."""
    if unicodedata.category(letter)[0] != "L":
        return None
    word = unicodedata.name(letter, "").split(" ", 1)[0]
    return {"CJK": "HAN", "KATAKANA-HIRAGANA": "KATAKANA"}.get(word, word) or None


class Looks:
    """Letters of one look, made from a table of confusable characters."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        kin: dict[tuple[str, bool], list[str]] = {}
        for letter in sorted({*table, *table.values(), *MORE_LOOKS.values()}):
            if len(letter) == 1 and unicodedata.category(letter) in ("Lu", "Ll", "Lt", "Lo", "Lm"):
                look = table.get(letter, letter)
                look = MORE_LOOKS.get(letter, MORE_LOOKS.get(look, look))
                if len(look) == 1 and unicodedata.decomposition(letter).partition(" ")[0] not in _TAGS:
                    # case is visible, so capital and small letters are never one look
                    cased = letter if unicodedata.category(letter) in ("Lu", "Ll") else look
                    kin.setdefault((look, unicodedata.category(cased) == "Lu"), []).append(letter)
        #: Each letter to the spellings of its look by script; Latin ones are those of the basic alphabet.
        self.spellings: dict[str, dict[str, str]] = {}
        #: East Asian letters that look like one of another script there, to (spelling beside kana, spelling elsewhere).
        self.east: dict[str, tuple[str, str]] = {}
        for letters in kin.values():
            by: dict[str, str] = {}
            for letter in letters:
                script = _script(letter)
                if script and (script != "LATIN" or letter.isascii()):
                    by.setdefault(script, letter)
            eastern = {s: by[s] for s in ("HAN", "HIRAGANA", "KATAKANA") if s in by}
            if "KATAKANA" in eastern and len(eastern) > 1:
                for letter in eastern.values():
                    self.east[letter] = (eastern["KATAKANA"], next(iter(eastern.values())))
            western = {s: c for s, c in by.items() if s not in ("HAN", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO")}
            if len(western) > 1:
                for letter in letters:
                    if _script(letter) in western and (_script(letter) != "LATIN" or letter.isascii()):
                        self.spellings[letter] = western
        self.forms = _forms(set(self.spellings) | set(self.east))
        strange = {c for c in self.spellings if not c.isascii()}
        strange |= {c for c in map(chr, range(0x80, 0x3000)) if unicodedata.normalize("NFD", c)[0] in strange}  # with accents
        #: Letters that a token may have to be respelt for. Sets, as a pattern of so many letters is slower to search for.
        self.suspect, self.formed = frozenset(strange), frozenset(map(chr, self.forms))
        self.eastern = regex.compile(f"[{''.join(sorted(self.east))}]+") if self.east else regex.compile(r"(?!)")

    def __reduce__(self):
        return Looks, (self.table,)


def _forms(kept: set[str]) -> dict[int, str]:
    """Characters that are another's width, font, ligature or radical, by the tag of their decomposition; letters with a look of their
    own aren't among them."""
    table: dict[int, str] = {ord(a): b for a, b in RADICALS.items()}
    for code in range(0x80, 0x30000):
        tag = unicodedata.decomposition(chr(code)).partition(" ")[0]
        if tag in _TAGS:
            plain = unicodedata.normalize("NFKC", chr(code))
            if chr(code) not in kept and (plain == " " or " " not in plain):
                table[code] = plain
    return table | {0x2010: "-", 0x2011: "-"} | {ord(a): b for a, b in DRAWN_ALIKE.items()}


@functools.cache
def known_looks() -> Looks:
    """The looks of the public table."""
    return Looks(confusables())


def resolved(token: str, looks: Looks) -> tuple[str, str | None]:
    """A token in the script in which it is wholly spelt, and what it was: mixed, whole (a whole-script confusable) or null; see the module."""
    letters = unicodedata.normalize("NFD", token)
    left: set[str] | None = None
    own: set[str] = set()
    count: dict[str, int] = {}
    several = sum(_script(c) is not None for c in letters) > 1
    for letter in letters:
        script = _script(letter)
        if script:
            own.add(script)
            spelt = looks.spellings.get(letter, {script: letter}) if several or letter not in ALONE else {script: letter}
            left = set(spelt) if left is None else left & set(spelt)
            for s in spelt:
                count[s] = count.get(s, 0) + 1
    if not own:
        return letters, None
    order = lambda s: (SCRIPTS.index(s) if s in SCRIPTS else len(SCRIPTS), s)
    script = min(left, key=order) if left else min(count, key=lambda s: (-count[s], *order(s)))
    made = "".join(c if _script(c) == script or (not several and c in ALONE) else looks.spellings[c].get(script) or _first(looks.spellings[c], order) if c in looks.spellings else c for c in letters)
    return made, "mixed" if len(own) > 1 else "whole" if made != letters else None


def _first(spellings: dict[str, str], order) -> str:
    return spellings[min(spellings, key=order)]


def respell(token: str, looks: Looks | None = None) -> str:
    """A token in the script in which it is wholly spelt."""
    return resolved(token, looks or known_looks())[0]


def _beside_kana(m: regex.Match, looks: Looks) -> str:
    around = m.string[max(0, m.start() - 1) : m.start()] + m.string[m.end() : m.end() + 1]
    kana = any(_KANA.match(c) for c in around)
    return "".join(looks.east[c][0 if kana else 1] for c in m.group())


def _plain(text: str, looks: Looks) -> str:
    """A text without invisible characters and other widths, fonts, ligatures and radicals, composed."""
    text = _DROP.sub("", text)
    return unicodedata.normalize("NFC", text if looks.formed.isdisjoint(text) else text.translate(looks.forms))


def one_form(text: str, looks: Looks | None = None) -> str:
    """The form that all texts of one look have."""
    if not text.isascii():
        looks = looks or known_looks()
        text = _plain(text, looks)
        if not looks.suspect.isdisjoint(text):
            text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: m.group() if looks.suspect.isdisjoint(m.group()) else resolved(m.group(), looks)[0], text))
        if _KANA.search(text):
            text = looks.eastern.sub(lambda m: _beside_kana(m, looks), text)
    text = _LINES.sub("\n", text)
    return _AROUND.sub("\n", _BLANKS.sub(" ", text)).strip()


def suspects(text: str, looks: Looks | None = None) -> list[tuple[str, str, str]]:
    """(token, mixed or whole, its one spelling) of each token of a text whose letters aren't those of the script that it looks to be in."""
    if text.isascii():
        return []
    looks = looks or known_looks()
    out = []
    for m in _TOKEN.finditer(_plain(text, looks)):
        if not looks.suspect.isdisjoint(m.group()):
            made, what = resolved(m.group(), looks)
            if what:
                out.append((m.group(), what, unicodedata.normalize("NFC", made)))
    return out


def one_forms(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """``kind``, ``id`` and ``form`` of each row: null for a null text, '' for an empty or blank one. Repeated rows stay."""

    looks = known_looks()  # a table of fixed size, sent along

    def make():
        def form(key: int, text: str | None) -> Iterator[tuple]:
            return iter([(kind, key, None if text is None else one_form(text, looks))])

        return form

    return map_rows(spread(df.select(F.col(key).cast("bigint"), F.col(text))), "kind string, id bigint, form string", make)


def suspect_tokens(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """``kind``, ``id``, ``token``, ``what`` (mixed or whole) and ``spelling`` of each different suspect token of each row; see ``suspects``. Null and
    empty texts have none; repeated rows give theirs each."""
    looks = known_looks()

    def make():
        def found(key: int, text: str) -> Iterator[tuple]:
            return ((kind, key, *row) for row in sorted(set(suspects(text, looks))))

        return found

    return map_rows(spread(df.select(F.col(key).cast("bigint"), F.col(text).alias("_text")).where("_text IS NOT NULL")), "kind string, id bigint, token string, what string, spelling string", make)


def _digests(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``kind``, ``id``, ``form`` and ``text`` (both as digests) of each record that shows something, in a written table."""
    looks = known_looks()

    def make(kind: str):
        digest = lambda s: hashlib.blake2b(s.encode(), digest_size=20).digest()

        def hashed(key: int, text: str) -> Iterator[tuple]:
            form = one_form(text, looks)
            return iter([(kind, key, digest(form), digest(text))] if form else [])

        return lambda: hashed

    rows = None
    for df, kind, key, text in parts:
        given = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL AND t != ''")
        part = map_rows(spread(given), "kind string, id bigint, form binary, text binary", make(kind))
        rows = part if rows is None else rows.unionAll(part)
    return write_shared(rows, "forms")


def look_classes(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``kind``, ``id``, ``class_id`` (the smallest id of the class), ``links`` and ``texts`` of each record that looks like one of another string:
    how many records of its class have another string, and how many strings the class has. One row a record, however large the class.

    ``parts`` are (table, kind, id column, text column). A record whose id comes with several texts is a member by each of them; repeated
    rows count once. Nothing is gathered: members are counted before they are shuffled, and join the counts."""
    rows = _digests(parts).distinct()
    texts = rows.groupBy("kind", "form", "text").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    classes = texts.groupBy("kind", "form").agg(F.sum("n").alias("total"), F.count("*").alias("texts"), F.min("first").alias("class_id")).where("texts > 1")
    counts = write_shared(texts.join(classes, ["kind", "form"]).select("kind", "text", "class_id", (F.col("total") - F.col("n")).alias("links"), "texts"), "classes")
    return rows.select("kind", "id", "text").join(counts, ["kind", "text"]).select("kind", "id", "class_id", "links", "texts")


def same_look(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``kind``, ``a_id`` < ``b_id``: every pair of records of a kind that look the same and are different strings.

    ``parts`` are (table, kind, id column, text column). Null, empty and blank texts show nothing and are in no pair; rows with
    the same id are no pair, and repeated rows give each pair once. Different texts of one form are paired first, as classes;
    the pairs of classes are then expanded by membership, so equal copies are never compared with each other. Where classes are
    large ``look_classes`` says the same in a row a record."""
    rows = _digests(parts)
    classes = rows.select("kind", "form", "text").distinct()
    several = classes.groupBy("kind", "form").agg((F.min("text") != F.max("text")).alias("several")).where("several").select("kind", "form")
    classes = write_shared(classes.join(several, ["kind", "form"], "left_semi"), "looks")
    pairs = classes.alias("a").join(classes.alias("b"), (F.col("a.kind") == F.col("b.kind")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.text") < F.col("b.text")))
    pairs = pairs.select(F.col("a.kind").alias("kind"), F.col("a.text").alias("t1"), F.col("b.text").alias("t2"))
    ids = rows.select("kind", "id", "text").distinct()
    first = pairs.join(ids.select("kind", F.col("text").alias("t1"), F.col("id").alias("i1")), ["kind", "t1"])
    both = first.join(ids.select("kind", F.col("text").alias("t2"), F.col("id").alias("i2")), ["kind", "t2"]).where("i1 != i2")
    return both.select("kind", F.least("i1", "i2").alias("a_id"), F.greatest("i1", "i2").alias("b_id"))


def _parts(spark, folder: str) -> list[tuple[DataFrame, str, str, str]]:
    pages, cards = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("doc_pages", "word_cards"))
    blocks = pages.select(F.explode("structured_data.contents").alias("b")).select("b.content_id", "b.content")
    return [(blocks, "content", "content_id", "content"), (cards.select("card_id", "word"), "word", "card_id", "word")]


def p3_found(spark, folder: str) -> DataFrame:
    """Pairs of blocks and of words that look the same and are stored in different characters."""
    return same_look(_parts(spark, folder))


def p3_forms(spark, folder: str) -> DataFrame:
    """The one form of each block and word."""
    (a, b) = (one_forms(*part) for part in _parts(spark, folder))
    return a.unionAll(b)


def p3_tokens(spark, folder: str) -> DataFrame:
    """The mixed and whole-script confusable tokens of each block and word."""
    (a, b) = (suspect_tokens(*part) for part in _parts(spark, folder))
    return a.unionAll(b)


def p3_classes(spark, folder: str) -> DataFrame:
    """The class of each block and word that looks like another of a different string."""
    return look_classes(_parts(spark, folder))


def _form_sql() -> str:
    """A form letter by letter, without this module's tables: compatibility forms by Python's Unicode data, and the Cyrillic and Greek letters
    that are drawn like Latin ones written out. Right for texts without words of these scripts, as all given ones are."""
    looks = ("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳɡ", "ABESIJKMHOPCTYXaeopcyxsijhdwABEZHIKMNOPTYXovjg")
    single, several = {}, {}
    for code in (*range(0x2000, 0x2070), *range(0x2E80, 0x3000), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), 0xA0):
        plain = unicodedata.normalize("NFKC", chr(code))
        if plain != chr(code) and (plain == " " or " " not in plain) and plain != "'":
            (single if len(plain) == 1 else several)[chr(code)] = plain
    single |= {chr(c): p for c, p in ((0x2010, "-"), (0x2011, "-"))} | {"⻅": "见", "⻚": "页", "⻓": "长", "⻔": "门", "⻋": "车"} | dict(zip(*looks, strict=True))
    form = f"translate(regexp_replace(t, '[\\p{{Cf}}]', '', 'g'), '{''.join(single)}', '{''.join(single.values()).replace(chr(39), chr(39) * 2)}')"
    for code, plain in several.items():
        if "\ufb00" <= code <= "\ufb06" or code == "\u2026":
            form = f"replace({form}, '{code}', '{plain}')"
    return f"trim(regexp_replace(nfc_normalize({form}), '[ \\t\\p{{Zs}}]+', ' ', 'g'))"


_RECORDS = f"""WITH r AS (SELECT 'content' AS kind, c.content_id AS id, c.content AS t FROM (SELECT unnest(structured_data.contents) AS c FROM doc_pages) UNION ALL SELECT 'word', card_id, word FROM word_cards),
f AS (SELECT DISTINCT kind, id, t, {_form_sql()} AS form FROM r WHERE t <> '')"""
QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms, "p3_tokens": p3_tokens, "p3_classes": p3_classes}
SQL = {
    "p3_found": _RECORDS + " SELECT DISTINCT a.kind, a.id AS a_id, b.id AS b_id FROM f a JOIN f b ON a.kind = b.kind AND a.form = b.form AND a.id < b.id AND a.t <> b.t WHERE a.form <> ''",
    "p3_classes": _RECORDS + """, x AS (SELECT kind, form, t, count(*) AS n, min(id) AS first FROM f WHERE form <> '' GROUP BY ALL), c AS (SELECT kind, form, sum(n)::BIGINT AS total, count(*) AS texts, min(first) AS class_id FROM x GROUP BY kind, form HAVING count(*) > 1)
SELECT kind, id, class_id, total - n AS links, texts FROM f JOIN x USING (kind, form, t) JOIN c USING (kind, form)""",
}
