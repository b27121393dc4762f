"""Sentences of texts in several languages and scripts.

Rules are pairs of regular expressions, one for what stands before a position and one for what follows; each says break or
no break. They are kept in tables by language. For a text the tables of its language, of related ones and the common one are
put in a row (the cascade). Positions are after end marks and their closing marks, before empty lines and, in Thai, at blanks; at
each the first rule that matches both sides decides, and nothing else does. A rule may also ask that what stands before the
position is all that the sentence has so far.

The rules see a copy of the text in which invisible characters are left out, look-alike letters and full-width letters are
plain, and quotations are marked in one pass: end marks within a quotation are other characters, and its closing mark tells
whether a colon or comma introduced it. So no rule looks back further than a few words, however long the text is. Offsets are
those of the stored text.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_rows, spread

BREAK, GO_ON = True, False
#: Private characters of the marked copy: a quieted end mark; a closing quote of introduced and of other quotations.
QUIET, SAID, QUOTED = "", "", ""
_HIDDEN = r"\p{Cf}͏᠋-᠏︀-️"
#: End marks that are nothing else: of Chinese and Japanese, Devanagari, Arabic and Urdu, Ethiopic, Khmer, Armenian, Burmese, Tibetan.
_SURE = "。！？｡।॥‼⁇⁈⁉؟۔።፧។៕։။།"
_ENDS = ".!?…" + _SURE
#: Before a rule's left side: the position's sentence has nothing else so far.
ALL = "\ue003"
_CLOSE = rf")\]）】〕〉’{SAID}{QUOTED}"

# Abbreviations by what may follow them. Before a name or number: never the end of a sentence.
LEADING = {
    "en": "Dr Mr Mrs Ms Prof St Mt Rev Hon Gen Col Capt Sgt Sen Rep Gov Fig Figs Sec Secs Ch Chs App Eq Eqs No Nos Vol Vols Ref Refs Art vol vols p pp ch sec fig figs no nos cf vs viz approx e.g i.e ed eds resp ca al",
    "de": "Dr Prof Hr Fr Frl St Nr Abb Kap S Bd Tab Abs Art Anm Aufl Hrsg vgl bzw ca z.B z. B d.h d. h u.a u. a i.d.R sog ggf evtl inkl exkl max min bspw mind Str Tel z d u",
    "fr": "M MM Mme Mmes Mlle Mlles Dr Pr Mgr St Ste p pp fig figs vol chap art cf env éd coll p. ex c.-à-d réf tél bd av apr max min",
    "ru": "ул д кв стр рис табл гл см ср проф акад им т. е т. к напр тыс млн млрд руб коп пл просп обл ред изд доц гр мин макс",
    "es": "Dr Dra Sr Sra Srta Sres Ud Uds D Dña Prof Profa Lic Ing pág págs p pp núm núms art arts cap caps fig figs vol vols ej p. ej ed aprox máx mín av Avda tel cf vs",
}
# Abbreviations that may also end a sentence: there, if a capital follows.
TRAILING = {"fr": "etc J.-C apr. J.-C av. J.-C", "ru": "т. д т. п др пр н. э", "en": "etc a.m p.m Corp Inc Ltd Co Jr Sr Bros Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec f ff seq Ave Blvd Rd dept est ext", "de": "usw etc f ff AG GmbH Co Jh Jhd ugs", "es": "etc a.m p.m Cía S.A a.C d.C EE.UU"}
# Words that begin a sentence after an abbreviation of capitals (U.S., U.K.).
STARTERS = "The A An In On At By It Its This That These Those He She We They I You There Here When While Why What Which Who How If For From To But And Or So Most Many Only No Nobody Does Do Did Is Are Was Were After Before Both Each Every Some As With"
# Words before, and month names after, the number of an ordinal in German.
ORDINAL = "am im ab bis vom zum zur der die das den dem des seit beim"
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahr Auflage Kapitel Klasse Mal Stock Tag"


def _words(text: str) -> str:
    return "|".join(sorted((regex.escape(w).replace(r"\ ", r"\s?") for w in text.split()), key=len, reverse=True))


def _abbreviations(text: str) -> str:
    """Alternatives of a list in which a one-letter part after a point belongs to the word before it."""
    joined = regex.sub(r"(?<=\b\w\.) (?=\w+\b)", "~", text)
    return "|".join(sorted((regex.escape(w).replace(r"\~", r"\s?").replace("~", r"\s?") for w in joined.split()), key=len, reverse=True))


_NEXT_UP = r"\s*[\"“„«‘'(\[（¿¡]*\p{Lu}"
_EAST = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
_LATE = rf"[{_CLOSE}]*"

# Words that close a sentence in Thai, and words that open one.
THAI_LAST, THAI_FIRST = "ครับ ค่ะ คะ นะ แล้ว เลย ด้วย ไหม หรือไม่ เท่านั้น", "แต่ ดังนั้น อย่างไรก็ตาม นอกจากนี้ เพราะฉะนั้น ผม ฉัน เขา เรา มัน วันนี้ เมื่อ"
#: A number or letter that opens an item.
_ITEM = r"\s*[(（\[]?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)）\]]{1,2}"

#: Tables by name: (break or not, what stands before the position, what follows it).
RULES: dict[str, list[tuple[bool, str, str]]] = {
    "first": [
        (BREAK, r"", r"\n[^\S\n]*\n"),
        (GO_ON, rf"{QUIET}{_LATE}", r""),
        (GO_ON, ALL + _ITEM, r""),
        (GO_ON, rf"[{_ENDS}]{_LATE}", rf"\s?[,，、;；:：{_CLOSE}]"),
        (GO_ON, r"\.", r"[\p{Ll}\p{Nd}_/@-]"),
    ],
    "zh": [
        (BREAK, rf"[{_ENDS}]{SAID}", r"\s*\S"),
        (GO_ON, rf"[{_ENDS}]{_LATE}{QUOTED}", rf"\s?{_EAST}"),
        (GO_ON, rf"(?<![\p{{L}}.])(?:{_abbreviations(LEADING['en'])}|a\.m|p\.m|etc)\.", rf"\s*{_EAST}"),
        (BREAK, r"\.", rf"\s*{_EAST}"),
        (BREAK, r"…", rf"\s*{_EAST}"),
    ],
    "ja": [
        (GO_ON, rf"[{_ENDS}][{SAID}{QUOTED}]", r"\s?(?:と|って|の|が|は|を|に|で|も|や|な)"),
        (GO_ON, rf"[{_ENDS}]{_LATE}{QUOTED}", rf"\s?{_EAST}"),
        (BREAK, rf"[{_ENDS}]{SAID}", r"\s*\S"),
        (BREAK, r"[.…]", rf"\s*{_EAST}"),
    ],
    "hi": [
        (BREAK, rf"[{_ENDS}]{SAID}", r"\s*\S"),
        (GO_ON, rf"[{_ENDS}]{_LATE}{QUOTED}", r"\s*\p{Devanagari}"),
        (GO_ON, r"(?<!\p{L})(?:डॉ|श्री|प्रो|पृ|सं|रु|कु|स्व|ई|पू|उदा)\.", r"\s"),
        (BREAK, r"[.!?…]", r"\s+\p{Devanagari}"),
    ],
    "de": [
        (GO_ON, rf"(?<![\p{{L}}.])(?:{_abbreviations(LEADING['de'])})\.", r"\s"),
        (GO_ON, rf"(?<!\p{{L}})(?i:{_words(ORDINAL)})\s+\d{{1,2}}\.", r"\s"),
        (GO_ON, r"(?<!\d[.,])(?<!\d)\d{1,2}\.", rf"\s+(?:{_words(MONTHS)})\b"),
        (BREAK, rf"(?<![\p{{L}}.])(?:{_abbreviations(TRAILING['de'])})\.{_LATE}", _NEXT_UP),
    ],
    "fr": [
        (BREAK, rf"(?<![\p{{L}}.])(?:{_abbreviations(TRAILING['fr'])})\.{_LATE}", _NEXT_UP),
        (GO_ON, rf"(?<![\p{{L}}.])(?:{_abbreviations(LEADING['fr'])})\.", r"\s"),
        (GO_ON, rf"[{_ENDS}]{_LATE}{QUOTED}", r"\s*\p{Ll}"),
    ],
    "ru": [
        (BREAK, r"\d\s?гг?\.", _NEXT_UP),
        (GO_ON, r"(?<![\p{L}.])гг?\.", r"\s"),
        (BREAK, rf"(?<![\p{{L}}.])(?:{_abbreviations(TRAILING['ru'])})\.{_LATE}", _NEXT_UP),
        (GO_ON, rf"(?<![\p{{L}}.])(?:{_abbreviations(LEADING['ru'])})\.", r"\s"),
        (GO_ON, r"(?<!\p{L})\p{Lu}\.", r"\s*\p{Lu}"),
    ],
    "th": [
        (BREAK, rf"(?:{_words(THAI_LAST)})ๆ?", r" +\p{Thai}"),
        (BREAK, r"\p{Thai}", rf" +(?:{_words(THAI_FIRST)})"),
        (GO_ON, r"[\p{Thai}ๆฯ]", r" "),
    ],
    "es": [
        (GO_ON, rf"(?<![\p{{L}}.])(?:{_abbreviations(LEADING['es'])})\.", r"\s"),
        (BREAK, rf"(?<![\p{{L}}.])(?:{_abbreviations(TRAILING['es'])})\.{_LATE}", _NEXT_UP),
    ],
    "en": [
        (BREAK, r"(?:App|Fig|Sec|Eq|Ch|Part|Unit|Table)\.?\s\p{Lu}\.", _NEXT_UP),
        (GO_ON, rf"(?<![\p{{L}}.])(?:{_abbreviations(LEADING['en'])})\.", r"\s"),
        (BREAK, rf"(?<![\p{{L}}.])(?:{_abbreviations(TRAILING['en'])})\.{_LATE}", _NEXT_UP),
        (BREAK, r"(?<![\p{L}.])(?:\p{Lu}\.){2,}", rf"\s+(?:{_words(STARTERS)})\b"),
        (GO_ON, r"(?<![\p{L}.])(?:\p{Lu}\.){2,}", r"\s+\p{Lu}"),
        (GO_ON, r"(?<!\p{L})\p{Lu}\.", r"\s+\p{Lu}"),
    ],
    "common": [
        (BREAK, rf"[{_SURE}]{_LATE}", r"\s*\S"),
        (GO_ON, rf"[.!?…]{_LATE}", r"\s*[\p{Ll}]"),
        (GO_ON, r"[\p{L}\p{Nd}]\.", r"\p{Lu}(?![\p{Ll}\s])"),
        (BREAK, rf"[.!?…]{_LATE}", r"\s+\S"),
        (BREAK, rf"[.!?…]{_LATE}", r"[\"“„«‘(\[（¿¡「『《\p{Lu}]"),
        (BREAK, rf"[!?…]{_LATE}", r"\S"),
    ],
}
CASCADES = {lang: ("first", lang, *(t for t in ("en", "de", "es") if t != lang), "common") for lang in ("zh", "ja", "hi", "th", "ru", "fr", "de", "es", "en")}


# Letters that look like Latin ones, in the order of the Latin line below.
_LOOK = str.maketrans("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕЅІЈКМНОРСТХаеорсухѕіјһԁԝνοϳɡ", "ABEZHIKMNOPTYXABESIJKMHOPCTXaeopcyxsijhdwvojg") | {c: c - 0xFEE0 for c in (0xFF0E, *range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_SPACE = {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9)} | {c: "\n" for c in (0xB, 0xC, 0x85, 0x2028, 0x2029)}
_PLAIN = _LOOK | _SPACE


def _compiled(tables: tuple[str, ...], point: bool) -> list[tuple[bool, regex.Pattern, regex.Pattern | None]]:
    """The rules of the tables as (verdict, pattern at the position, pattern of all of the sentence before it); without those that need a point
    where the end mark has none."""
    out = []
    for verdict, before, after in (rule for table in tables for rule in RULES[table]):
        if before.startswith(ALL):
            out.append((verdict, regex.compile(f"(?={after})"), regex.compile(before[1:] + r"\s*")))
        elif point or r"\." not in before.replace(_LATE, "")[-3:]:
            # letters in the copy have their plain look, so those of the rules must too
            out.append((verdict, regex.compile(f"(?<={before})(?={after})".translate(_LOOK) if tables[1] == "ru" else f"(?<={before})(?={after})"), None))
    return out


#: For each language the rules after end marks with a point in them, and after others.
_COMPILED = {lang: (_compiled(tables, True), _compiled(tables, False)) for lang, tables in CASCADES.items()}
#: Where rules are asked: after end marks, be they in a quotation or not, before empty lines, in Thai at blanks between letters.
_PLACES = rf"[{_ENDS}{QUIET}]+{_LATE}|(?=\n[^\S\n]*\n)"
_SPOT, _SPOT_THAI = regex.compile(_PLACES), regex.compile(_PLACES + r"|(?<=\p{Thai})(?= +\p{Thai})")
_QUOTE = regex.compile(rf"[\"“”„«»「」『』《》]|\n[^\S\n]*\n|[{_ENDS}]+")
_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "《": "》"}
_SCRIPT = {"ru": regex.compile(r"[бгдёжзийлпфцчшщъыьэюя]", regex.I), "th": regex.compile(r"\p{Thai}"), "hi": regex.compile(r"\p{Devanagari}"), "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "zh": regex.compile(r"\p{Han}")}
_WEST = {"de": regex.compile(r"\b(?:der|die|das|und|wird|ist|mit|von|für|nicht|eine?|auf|im|nach)\b", regex.I), "fr": regex.compile(r"\b(?:le|les|des|du|au|aux|est|une|dans|pour|avec|qui|sur|pas|et|cette)\b", regex.I), "es": regex.compile(r"\b(?:el|la|los|las|una?|de|del|que|se|en|por|con|hay)\b", regex.I), "en": regex.compile(r"\b(?:the|and|of|is|to|in|that|with|for|was|are|this|by|has)\b", regex.I)}

#: What makes a text differ from its copy.
_ODD = regex.compile(rf"[{_HIDDEN}{regex.escape(''.join(map(chr, _PLAIN)))}]")
_SHOWN = regex.compile(rf"[^{_HIDDEN}]+")


def language(text: str) -> str:
    """The language whose rules a text gets: by script, in Latin script by its frequent words."""
    if text.isascii():
        return "en"
    for lang, script in _SCRIPT.items():
        if script.search(text):
            return lang
    counts = {lang: len(words.findall(text)) for lang, words in _WEST.items()}
    return max(counts, key=lambda lang: (counts[lang], lang == "en"))


def _marked(text: str) -> str:
    """The copy with its quotations marked, of the same length. A quotation ends with its paragraph at the latest; one that is
    never closed is none."""
    out: list[str] | None = None
    opened: list[tuple[str, int, list[tuple[int, int]]]] = []
    for m in _QUOTE.finditer(text):
        token, at = m.group(), m.start()
        if token[0] == "\n":
            opened.clear()
        elif token[0] in _ENDS:
            if opened:
                opened[-1][2].append(m.span())
        elif opened and token == _PAIRS.get(opened[-1][0], '"'):
            mark, start, ends = opened.pop()
            out = out if out is not None else list(text)
            for a, b in ends:
                if b != at or token == "》":
                    out[a:b] = QUIET * (b - a)
            before = text[max(0, start - 2) : start].rstrip()
            out[at] = SAID if before.endswith((":", "：", ",", "，")) else QUOTED
            if opened:
                opened[-1][2].extend(ends)
        elif token in _PAIRS or token == '"':
            opened.append((token, at, []))
    return text if out is None else "".join(out)


def sentences(text: str) -> list[tuple[int, int]]:
    """The (start, end) of each sentence in code points of the text as stored."""
    index: list[int] | None = None
    plain = text.replace("\r", "\n") if "\r\n" not in text else text.replace("\r\n", " \n").replace("\r", "\n")
    if not text.isascii():
        if _ODD.search(plain):
            plain = plain.translate(_PLAIN)
            shown = [m.span() for m in _SHOWN.finditer(plain)]
            if sum(b - a for a, b in shown) != len(plain):
                index = [i for a, b in shown for i in range(a, b)]
                plain = "".join(plain[a:b] for a, b in shown)
        lang = language(plain)
    else:
        lang = "en" if not any(_WEST[w].search(text) for w in ("de", "es", "fr")) else max(_WEST, key=lambda w: (len(_WEST[w].findall(text)), w == "en"))
    marked = _marked(plain)
    pointed, others = _COMPILED[lang]
    out: list[tuple[int, int]] = []
    size = len(marked)

    def close(a: int, b: int) -> None:
        piece = plain[a:b]
        a += len(piece) - len(piece.lstrip())
        b -= len(piece) - len(piece.rstrip())
        if a < b:
            out.append((a, b))

    start = 0
    for m in (_SPOT_THAI if lang == "th" else _SPOT).finditer(marked):
        at = m.end()
        if at >= size:
            break
        for verdict, rule, whole in pointed if "." in m.group() else others:
            if (whole is None or (at - start <= 12 and whole.fullmatch(marked, start, at))) and rule.match(marked, at):
                if verdict:
                    close(start, at)
                    start = at
                break
    close(start, size)
    if index is not None:
        out = [(index[a], index[b - 1] + 1) for a, b in out]
    return out


def sentence_rows(df: DataFrame) -> DataFrame:
    """Rows (kind, item_id, sense_no, example_no, text) to one row a sentence, with ``sent_start`` and ``sent_end`` in place of the
    text. Null, empty and blank texts give none; a text of any length is one input; repeated rows give their sentences each."""

    def make():
        def split(kind: str, item: int, sense: int, example: int, text: str) -> Iterator[tuple]:
            return ((kind, item, sense, example, a, b) for a, b in sentences(text))

        return split

    schema = "kind string, item_id bigint, sense_no int, example_no int, sent_start int, sent_end int"
    return map_rows(spread(df.select("kind", "item_id", "sense_no", "example_no", "text").where("text IS NOT NULL")), schema, make)


def _texts(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    pages, cards = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("doc_pages", "word_cards"))
    blocks = pages.select(F.explode("structured_data.contents").alias("b")).select(F.lit("content").alias("kind"), F.col("b.content_id").alias("item_id"), F.lit(0).alias("sense_no"), F.lit(0).alias("example_no"), F.col("b.content").alias("text"))
    senses = cards.select(F.col("card_id"), F.posexplode("senses").alias("sense_no", "s"))
    examples = senses.select("card_id", "sense_no", F.posexplode("s.examples").alias("example_no", "e"))
    examples = examples.select(F.lit("example").alias("kind"), F.col("card_id").alias("item_id"), "sense_no", "example_no", F.col("e.text").alias("text"))
    return blocks, examples


def p5_found(spark, folder: str) -> DataFrame:
    """The sentences of all blocks and examples."""
    blocks, examples = _texts(spark, folder)
    return sentence_rows(blocks).unionAll(sentence_rows(examples))


def p5_shown(spark, folder: str) -> DataFrame:
    """How many code points that show the sentences of each block and example have: all that the text has."""
    blocks, examples = _texts(spark, folder)
    key = ["kind", "item_id", "sense_no", "example_no"]
    rows = p5_found(spark, folder).join(blocks.unionAll(examples), key)
    own = F.expr("substring(text, sent_start + 1, sent_end - sent_start)")
    return rows.groupBy(*key).agg(F.sum(F.length(F.regexp_replace(own, _BLANK, ""))).cast("bigint").alias("shown"))


_BLANK = r"[\p{Z}\p{C}]"
QUERIES = {"p5_found": p5_found, "p5_shown": p5_shown}
SQL = {
    "p5_shown": f"""WITH t AS (SELECT 'content' AS kind, c.content_id AS item_id, 0 AS sense_no, 0 AS example_no, c.content AS text FROM (SELECT unnest(structured_data.contents) AS c FROM doc_pages)
UNION ALL SELECT 'example', card_id, sense_no, generate_subscripts(examples, 1)::INT - 1, unnest(examples).text FROM (SELECT card_id, generate_subscripts(senses, 1)::INT - 1 AS sense_no, unnest(senses).examples AS examples FROM word_cards)),
n AS (SELECT kind, item_id, sense_no, example_no, length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS shown FROM t)
SELECT * FROM n WHERE shown > 0"""
}
