"""Records that hold template residue, filler or an error page instead of notes.

A record is cut into passages: its lines, without code and formulas, and the short spans in them that brackets or template marks
enclose, or that are the whole value of a label. A naive Bayes model tells passages of residue from others. It is learnt from
positive and unlabelled passages of all records: trusted ones are positive, the others begin as negative and get their share of
either class by expectation-maximization. Every passage of every record is scored, and a record is decided on the scores: a
span left to fill in is enough; messages and filler must be the body, not a remark in it.

Trusted are passages of the data itself: the lines of a short record that ends in a trace id or names an HTTP status; the lines
of a short body that several records have under different titles; spans in the form of a known template language; lines of a few
words over and over. Messages of public server software, which needn't occur in the data, are added as records of their own.
What the unlabelled passages may add to the positive class is bounded by what is trusted, so a language or a subject of many
unlabelled passages can't become the class.

Features are hashed to a fixed number of places, so a round of expectation-maximization is one pass over the records, whose
sums are one row a place and task; nothing grows with the data but the passes. Sums are whole numbers, so the model is the same
whatever the partitions.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from http import HTTPStatus

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_rows, spread
from millrace.sources.shared import write_shared

#: Places that the features of lines, and as many that those of spans, are hashed to (a power of two); rounds of
#: expectation-maximization; parts of one in the whole-number sums.
PLACES, ROUNDS, UNIT = 1 << 18, 5, 1 << 20
#: Sums over all records: one a place, then the number of lines and of spans.
_SUMS = 2 * PLACES + 2
#: Passages that a feature's rate over all counts for beside its rate in a class, and the bounds of its log-odds.
BACKGROUND, LEAST, MOST = 4.0, -3.0, 6.0
#: Log-odds from which a passage is residue, and the part of a body that residue must be.
CUT, SHARE = 0.0, 0.5
#: A passage's share of the positive class below which it counts as negative: many passages of a small share can't move the class.
LIKELY = 0.5
#: Code points and lines of a short body; records that must have it, under different titles, to be trusted.
SHORT, SHORT_LINES, AGAIN = 240, 3, 3
#: Code points of a span at most.
SPAN = 120

# Messages of public server software and frameworks, and of their translations: records to learn from.
PUBLIC = """The requested URL was not found on this server.
Oops! That page can't be found. It looks like nothing was found at this location.
There is currently no text in this page.
You don't have permission to access this resource.
The server encountered an internal error or misconfiguration and was unable to complete your request.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
The gateway did not receive a timely response from the upstream server.
The proxy server received an invalid response from an upstream server.
We're sorry, but something went wrong. If you are the application owner check the logs for more information.
An error occurred. Sorry, the page you are looking for is currently unavailable. Try again in a few minutes.
Checking if the site connection is secure. Please stand by, while we are checking your browser.
Your session has timed out. Please log in again.
You need to enable JavaScript to run this app.
JavaScript must be enabled in order for you to use this site. However, it seems JavaScript is either disabled or not supported by your browser.
For full functionality of this site it is necessary to enable JavaScript. Turn on scripting in your browser and reload the page.
If you see this page, the web server is successfully installed. Replace this file with your own content.
This page is under construction. Content to be added. TBD. To do: fill in this section.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Der angeforderte URL konnte auf dem Server nicht gefunden werden.
Der Zugriff auf das angeforderte Objekt ist nicht möglich. Es ist ein Fehler aufgetreten.
Um diese Anwendung zu verwenden, muss JavaScript im Browser aktiviert sein.
Diese Seite befindet sich im Aufbau. Inhalt folgt.
No se ha localizado la URL solicitada en este servidor.
Se ha producido un error interno en el servidor. No tiene permiso para acceder.
Debe activar JavaScript en el navegador para utilizar esta aplicación.
Página en construcción. Contenido pendiente.
要求された URL は本サーバでは見つかりませんでした。
サーバ内部で障害が発生しました。アクセスする権限がありません。後でもう一度試してください。
このサイトを利用するには、ブラウザの JavaScript を有効にする必要があります。
このページは準備中です。内容は後日追加します。
在服务器上没有找到请求的网址。网页不存在。
您没有访问该资源的权限。拒绝访问。
服务器遇到内部错误，无法完成您的请求，请稍后重试。
您的会话已超时，请重新登录。
您需要启用 JavaScript 才能运行此应用。请在浏览器设置中启用脚本后重新加载页面。
页面建设中，内容稍后添加。请在此处填写内容。
暂无正文，敬请期待。本节内容待完善，稍后补充。""".split("\n")
#: Records that one of the messages counts for.
PUBLIC_WEIGHT = 1

# The forms of placeholders of template languages, workflow expressions and notes to fill in: trusted spans.
KNOWN = regex.compile(
    r"""\{\{\{?[^{}\n]+\}?\}\}|\$\{[^{}\n]+\}|<%[=-]?[^%\n]+%>|\{%[^%\n]+%\}|\#\{[^{}\n]+\}|%\([\w.]+\)s
    |__[A-Z][A-Z0-9_]+__|\[\[[A-Z][A-Z0-9_]+\]\]|%[A-Z][A-Z0-9]*_[A-Z0-9_]+%|@@[\w.]+@@
    |\[(?i:insert|enter|add|your)\ [^\[\]\n]+\]|\[[^\[\]\n]+\ (?i:goes\ here|here)\]|<(?i:your|insert|enter)\ [^<>\n]+>
    |[【(（\[](?:此处|在此|请在此|请在|请填)[^】)）\]\n]+[】)）\]]|[【(（\[](?:ここに|hier|inserte|aquí)[^】)）\]\n]+[】)）\]]|\[object\ Object\]""",
    regex.X,
)
# What programs write for a value that isn't there.
UNFILLED = regex.compile(r"undefined|null|NaN|None|nil|NaN-NaN(?:-NaN)?|Invalid Date", regex.I)
#: Spans: template marks and brackets of any kind around a few words.
_SPAN = regex.compile(
    rf"""\{{\{{\{{?[^{{}}\n]{{1,{SPAN}}}\}}?\}}\}}|[$\#]?\{{[^{{}}\n]{{1,{SPAN}}}\}}|<%[^%\n]{{1,{SPAN}}}%>|\{{%[^%\n]{{1,{SPAN}}}%\}}|%\([\w.]{{1,{SPAN}}}\)s|__\w{{1,{SPAN}}}?__|%[A-Za-z]\w{{1,{SPAN}}}%
    |@@[\w.]{{1,{SPAN}}}@@|\[\[[^\[\]\n]{{1,{SPAN}}}\]\]|\[[^\[\]\n]{{1,{SPAN}}}\](?![(:\[])|<[^<>/\n=]{{1,{SPAN}}}>|【[^【】\n]{{1,{SPAN}}}】|[（(][^（）()\n]{{1,{SPAN}}}[）)]""",
    regex.X,
)
_SPAN_HINT = regex.compile(r"[{%\[<@【(（]|__")
#: A value that is all of a heading or of what follows a label.
_VALUE = regex.compile(r"\s*(?:(#{1,6})\s*|[\p{L}_ ]{1,30}[:：]\s*)([^\s#][^\n]{0,40}?)\s*$")
_WORDS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+|\p{Lu}?[\p{Ll}\p{Lo}\p{M}']+|\p{Lu}+(?!\p{Ll})")
_CODE = regex.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[^\n]*$|\Z)|`[^`\n]+`|\$\$.*?\$\$|(?<![\\$])\$(?![{$])[^$\n]+\$", regex.S | regex.M)
_CODE_HINT = regex.compile(r"[`~$]")
_HIDDEN = regex.compile(r"\p{Cf}+")
_TAG = regex.compile(r"</?[A-Za-z][^<>\n]*>")
_HTML = regex.compile(r"</?(?:h[1-6r]|p|div|span|i|b|em|strong|a|br|ul|ol|li|table|tr|td|th|img|code|pre|center|title|body|html|head|sub|sup|u|s|details|summary)\b[^<>\n]*>", regex.I)
_NUMBER = regex.compile(r"\d+(?:[.,]\d+)*")
_TRACE = regex.compile(r"\b[a-z]{2,12}-(?=[a-f]*\d)[0-9a-f]{5,32}\b|\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", regex.I)
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+|[\p{L}\p{M}']+|<\w+>")
_END = regex.compile(r"[.!?。！？…:：;；।][\"'”’»」』)）\]]*\s*$")
_BLOCK = regex.compile(r"^\s*(?:[-*+]\s|\d+[.)]\s|\||>\s)")
_EMPTY_LINE = regex.compile(r"(?:<trace>|<num>|[\s\W_])*+")
#: Public names of failures: "404 Not Found".
_STATUS = regex.compile("|".join(rf"{s.value}\W+{regex.escape(s.phrase)}" for s in HTTPStatus if s.value >= 400), regex.I)

TITLE, BODY, SLOT = 0, 1, 2
_SCHEMA = "doc_id bigint, places array<int>, sizes array<int>, lengths array<int>, roles array<int>, trusted array<boolean>, body_key bigint, title_key bigint, code int"
_places: dict[str, int] = {}


@dataclass
class Passage:
    """A line or span of a record: its features, its role, whether a pattern makes it trusted, and its weight as body text."""

    features: set[str]
    role: int
    trusted: bool
    length: int


def place(feature: str, span: bool = False) -> int:
    """Where a feature is counted."""
    at = _places.get(feature)
    if at is None:
        if len(_places) >= 500_000:
            _places.clear()
        _places[feature] = at = zlib.crc32(feature.encode()) & (PLACES - 1)
    return at + PLACES if span else at


def _line_features(line: str) -> list[str]:
    out: list[str] = []
    for word in _WORD.findall(line):
        if word[0] > "⺀":
            out += [word[i : i + 2] for i in range(len(word) - 1)] or [word]
        else:
            out.append(word)
    return out


def _span_features(kind: str, inner: str, alone: bool) -> set[str]:
    """Features of a span: its marks, the words in it, its form and whether it is all of its line."""
    words = _WORDS.findall(inner)
    out = {"marks " + kind, "alone" if alone else "within"}
    for word in words:
        if word[0] > "⺀":
            out.update("in " + word[i : i + 2] for i in range(max(1, len(word) - 1)))
        else:
            out.add("in " + word.casefold())
    bare = inner.strip()
    form = "number" if any(c.isdigit() for c in bare) else "upper" if bare.isupper() else "name" if regex.fullmatch(r"[=$\w. ]+", bare) and " " not in bare.lstrip("=$ ") else "words"
    out.add("form " + form)
    return out


def _marks(span: str) -> tuple[str, str]:
    """The marks around a span's words, and what they enclose."""
    start = len(span) - len(span.lstrip("{[<(（【$#%@_=-"))
    end = len(span.rstrip("}]>)）】%@_s" if span.startswith("%(") else "}]>)）】%@_-"))
    start = min(start, end)
    return span[:start].replace("=", "").replace("-", "") + " " + span[end:], span[start:end]


def _spans(line: str) -> list[Passage]:
    out = []
    rest = line.strip().lstrip("# ")
    value = _VALUE.match(line)
    if value and len(value.group(2)) <= 40:
        inner = value.group(2).strip("\"'")
        word = UNFILLED.fullmatch(inner) is not None
        if word or not regex.search(r"\s", inner):
            features = {"marks " + ("#" if value.group(1) else ":"), "alone", "is " + inner.casefold() if len(inner) <= 20 else "is long"}
            out.append(Passage(features, SLOT, word, 0))
    if _SPAN_HINT.search(line):
        for m in _SPAN.finditer(line):
            span = m.group()
            if span[0] == "<" and _HTML.fullmatch(span):
                continue
            kind, inner = _marks(span)
            if inner.strip():
                out.append(Passage(_span_features(kind, inner, span == rest), SLOT, KNOWN.fullmatch(span) is not None, 0))
    return out


def passages(text: str) -> tuple[list[Passage], int, str | None, str]:
    """The passages of a record, the code points of code and formulas in it, its masked body where that is short, and its title lines.

    A passage is trusted here by what is in the record alone; see ``marked`` for short bodies of several records."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text).replace("\u2028", "\n"))
    bare = _CODE.sub(" ", text) if _CODE_HINT.search(text) else text
    code = len(text) - len(bare)
    out: list[Passage] = []
    lines: list[Passage] = []
    masked: list[str] = []
    titles: list[str] = []
    failure = False
    number = 0
    for line in regex.split(r"[\r\n]+", bare):
        spans = _spans(line)
        out += spans
        plain = line
        if any(s.trusted for s in spans):
            plain = KNOWN.sub(" ", plain)
        trace = "-" in plain and _TRACE.search(plain) is not None
        if trace:
            plain = _TRACE.sub(" <trace> ", plain)
        plain = _NUMBER.sub(" <num> ", plain)
        if "<" in plain:
            plain = _TAG.sub(lambda m: m.group() if m.group() in ("<num>", "<trace>") else " ", plain)
        plain = plain.casefold()
        if _EMPTY_LINE.fullmatch(plain):
            failure = failure or trace
            continue
        status = len(line) <= 80 and _STATUS.search(line) is not None
        failure = failure or trace or status
        features = _line_features(plain)
        different = set(features)
        again = len(features) >= 12 and len(different) * 3 <= len(features)
        if again:
            different.add("over and over")
        content = trace or status or again or _END.search(line) is not None or _BLOCK.match(line) is not None
        role = TITLE if not content and number < 3 and len(titles) < 2 else BODY
        number += 1
        (titles if role == TITLE else masked).append(" ".join(plain.split()))
        part = Passage(different, role, again, len(line.strip()))
        lines.append(part)
        out.append(part)
    body = [p for p in lines if p.role == BODY]
    short = 0 < len(body) <= SHORT_LINES and code == 0 and sum(p.length for p in body) <= SHORT
    if short and failure:
        for part in body:
            part.trusted = True
    return out, code, "\n".join(masked) if short else None, "\n".join(titles)


def _key(text: str) -> int:
    return (zlib.crc32(text.encode()) << 31) ^ zlib.adler32(text.encode())


def _rows(doc: int | None, text: str) -> Iterator[tuple]:
    parts, code, body, title = passages(text)
    if not parts:
        return iter([])
    places = [sorted({place(f, p.role == SLOT) for f in p.features}) for p in parts]
    row = (doc, [x for own in places for x in own], [len(own) for own in places], [p.length for p in parts], [p.role for p in parts], [p.trusted for p in parts], None if body is None else _key(body), _key(title), code)
    return iter([row])


def parsed(records: DataFrame, key: Column, text: Column) -> DataFrame:
    """The passages of each record as places of their features, in a written table."""
    rows = records.select(key.cast("bigint").alias("doc_id"), text.alias("text")).where("text IS NOT NULL AND text != ''")
    return write_shared(map_rows(spread(rows), _SCHEMA, lambda: _rows), "passages")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: whether at least AGAIN records have this short body, and not all under one title. Only short records are
    shuffled, combined before by their keys."""
    short = rows.where("body_key IS NOT NULL")
    again = short.groupBy("body_key").agg(F.count("*").alias("n"), F.min("title_key").alias("a"), F.max("title_key").alias("b")).where(f"n >= {AGAIN} AND a != b").select("body_key", F.lit(True).alias("again"))
    found = write_shared(short.join(again, "body_key", "left").select(*rows.columns, F.coalesce("again", F.lit(False)).alias("again")), "short")
    return rows.where("body_key IS NULL").withColumn("again", F.lit(False)).unionByName(found)


class Batch:
    """The passages of an Arrow batch of records as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        self.places, sizes = flat("places"), flat("sizes").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.lengths, self.roles = flat("lengths").astype(np.int64), flat("roles")
        counts = np.array(batch.column("roles").value_lengths().to_numpy(zero_copy_only=False), np.int64)
        self.records = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        again = np.repeat(batch.column("again").to_numpy(zero_copy_only=False).astype(bool), counts)
        self.trusted = flat("trusted").astype(bool) | (again & (self.roles == BODY))
        self.code = batch.column("code").to_numpy(zero_copy_only=False).astype(np.int64)

    def scores(self, weights: np.ndarray, priors: np.ndarray) -> np.ndarray:
        return priors[(self.roles == SLOT).astype(int)] + np.add.reduceat(weights[self.places], self.starts)

    def residue(self, weights: np.ndarray, priors: np.ndarray) -> np.ndarray:
        """Which records are residue."""
        odd = self.scores(weights, priors) > CUT
        slot = np.add.reduceat((odd & (self.roles == SLOT)).astype(np.int64), self.records) > 0
        bad = np.add.reduceat(np.where(odd & (self.roles != SLOT), self.lengths, 0), self.records)
        good = np.add.reduceat(np.where(~odd & (self.roles == BODY), self.lengths, 0), self.records) + self.code
        return slot | ((bad > 0) & (bad >= SHARE * (bad + good)))


def _summed(rows: DataFrame, count, columns: int) -> np.ndarray:
    """Sums over all records, as many as _SUMS. ``count`` gives the sums of a batch. A task adds up its own
    first, so that many rows a task at most are shuffled, and that many come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, _SUMS), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += count(Batch(batch))
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(c[at]) for c in total]], names=["place", *[f"c{i}" for i in range(columns)]])

    parts = rows.mapInArrow(run, ", ".join(["place int", *[f"c{i} bigint" for i in range(columns)]]))
    table = parts.groupBy("place").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(columns)]).toArrow()
    out = np.zeros((columns, _SUMS), np.int64)
    for i in range(columns):
        out[i][table.column("place").to_numpy()] = table.column(f"c{i}").to_numpy()
    return out


def _weighed(batch: Batch, values: np.ndarray) -> np.ndarray:
    """Sums of whole numbers, one a passage, at the places of its features, and over lines and spans. They stay below 2^53, so are exact."""
    slot = batch.roles == SLOT
    return np.append(np.bincount(batch.places, values[batch.owner], minlength=2 * PLACES), [values[~slot].sum(), values[slot].sum()]).astype(np.int64)


def _trusted_counts(batch: Batch) -> np.ndarray:
    yes = batch.trusted.astype(np.int64)
    return np.stack([_weighed(batch, yes), _weighed(batch, 1 - yes)])


def _share_counts(batch: Batch, weights: np.ndarray, priors: np.ndarray) -> np.ndarray:
    share = np.rint(UNIT / (1 + np.exp(-np.clip(batch.scores(weights, priors), -30, 30))))
    return _weighed(batch, np.where(batch.trusted | (share < LIKELY * UNIT), 0, share).astype(np.int64))[None]


def learn(count, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds of each place and the priors of lines and spans. ``count(f, n)`` gives the ``n`` sums of ``f`` over all records."""
    trusted, others = (c.astype(float) for c in count(_trusted_counts, 2))
    for line in PUBLIC:
        trusted[[*{place(f) for p in passages(line)[0] if p.role != SLOT for f in p.features}, 2 * PLACES]] += PUBLIC_WEIGHT
    kind = np.repeat([0, 1], PLACES)
    (yes, n_yes), (no, n_no) = (np.split(c, [2 * PLACES]) for c in (trusted, np.maximum(others, 0)))
    n_no = np.maximum(n_no, 1)
    back = BACKGROUND * (yes + no) / (n_yes + n_no)[kind]
    seen = yes + no > 0
    more, weight, weights = np.zeros(2 * PLACES), np.zeros(2), np.zeros(2 * PLACES)
    for step in range(rounds + 1):
        before, weights = weights, np.zeros(2 * PLACES)
        up = (yes + more + back)[seen] / (n_yes + weight + BACKGROUND)[kind[seen]]
        down = (np.maximum(0, no - more) + back)[seen] / (np.maximum(1, n_no - weight) + BACKGROUND)[kind[seen]]
        weights[seen] = np.clip(np.log(up / down), LEAST, MOST)
        share = np.clip((n_yes + weight) / (n_yes + n_no), 1e-6, 0.5)
        priors = np.log(share / (1 - share))
        if step == rounds or np.abs(weights - before).max() < 0.05:
            break
        sums = count(lambda b, w=weights, p=priors: _share_counts(b, w, p), 1)[0] / UNIT
        # the unlabelled passages of a kind never weigh more than its trusted ones
        scale = np.minimum(1, n_yes / np.maximum(sums[2 * PLACES :], 1e-9))
        more, weight = sums[: 2 * PLACES] * scale[kind], sums[2 * PLACES :] * scale
    return weights, priors


def batch_of(texts: list[str]) -> pa.RecordBatch:
    """Texts as one batch of parsed records, ``doc_id`` their position; those without passages are left out."""
    return _batch([r for i, t in enumerate(texts) if t for r in _rows(i, t)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    titles: dict[int, list[int]] = {}
    for r in rows:
        if r[6] is not None:
            titles.setdefault(r[6], []).append(r[7])
    again = [r[6] is not None and len(titles[r[6]]) >= AGAIN and len(set(titles[r[6]])) > 1 for r in rows]
    names = ["doc_id", "places", "sizes", "lengths", "roles", "trusted", "body_key", "title_key", "code", "again"]
    kinds = [pa.int64(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    columns = [[r[i] for r in rows] for i in range(9)] + [again]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def fit_batch(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The model of one batch without Spark: the same sums over it."""
    batch = Batch(rows)
    return learn(lambda f, n: f(batch))


def residue(records: DataFrame, key: Column, text: Column) -> DataFrame:
    """The ``doc_id`` of each record to exclude, once each.

    Null, empty and blank texts aren't residue (they hold nothing to judge); texts are judged whole; repeated rows give their
    id once; an empty table gives no rows."""
    rows = marked(parsed(records, key, text))
    context = records.sparkSession.sparkContext
    model = context.broadcast(learn(lambda f, n: _summed(rows, f, n)))  # 2 * PLACES numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(Batch(batch).residue(*model.value)))], names=["doc_id"])

    return rows.mapInArrow(judge, "doc_id bigint").distinct()


def p8_found(spark, folder: str) -> DataFrame:
    """Documents to exclude."""
    return residue(spark.read.parquet(f"{folder}/documents.parquet"), F.col("doc_id"), F.col("text"))


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
