"""Template residue and error-page text: weak labels, a regularized linear classifier on hashed n-grams, scoring of all segments.

A document is cut into segments (sentences, lines, and windows round template marks). Weak labels come from status
lines and phrases, and serve for training only. The classifier is trained on a bounded sample of labelled segments from some hosts
(sources), its threshold is set on them and it is validated on hosts it has not seen; then it is trained once more on all hosts. Every
segment of every document is scored, and a document comes out if one of its scores reaches the threshold.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.session import spread, staged

BITS = 18
DENSE = 7
SAMPLE_DOCS = 30_000
SAMPLE_SEGMENTS = 80_000

_CUT = re.compile(r"(?<=[.!?])\s+|\n+|(?<=[。！？])")
_TOKEN = re.compile(r"[一-鿿]|[^\W\d_]+|\d+|[^\w\s.,;:'\"’“”-]+|__+")
_NUMBERED = re.compile(r"^\s*(?:\[\d+\]|\d+\.)\s*(?=\S)|^\s+")
_LEAD = re.compile(r"^\W+")
# A template mark: a name between marks, or words that ask for something to be filled in.
_NAME = r"[A-Za-z][\w. ]{0,40}?"
MARK = re.compile(rf"\{{\{{\s*{_NAME}\s*\}}\}}|[$#]\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\{{%\s*{_NAME}\s*%\}}|<<\s*{_NAME}\s*>>|\[\[\s*{_NAME}\s*\]\]|@@{_NAME}@@|__{_NAME}__|%[A-Za-z]\w{{1,40}}%|\$[A-Za-z]\w{{1,40}}\$|\{{[A-Za-z][\w ]{{0,40}}\}}|&lt;{_NAME}&gt;|<[A-Za-z][\w ]{{2,40}}>|\[[A-Za-zÀ-ÿ][\w ]{{2,40}}\]|\([\w ]{{2,40}} goes here\)|\bTODO\b:?(?: add| insert| write)?(?: [\w]+){{1,3}}")
# Names of the fields of a document, and words that ask for them.
FIELDS = frozenset("title abstract description claim claims claim_text inventor inventors applicant applicant_name country date filing_date body summary section name figure figures figure_list author text content address number id value placeholder company email phone url heading subject company_name first_name last_name insert here your enter add todo titel zusammenfassung beschreibung anspruch erfinder anmelder titre résumé description revendication inventeur déposant título resumen descripción reivindicación solicitante einfügen ajouter completar insertar insérer".split())
_SPECIAL = re.compile(r"<\|?/?(?:endoftext|startoftext|im_start|im_end|pad|unk|s|bos|eos|mask|sep|cls|su[bp])\|?>|\[(?:MASK|CLS|SEP|PAD|UNK|BOS|EOS)\]|##\w*##|\[(?:formula|formel|formule|fórmula|equation|image|bild|figure|drawing|table|tabelle|chem\w*|math\w*)\b[^\]]*\]", re.I)

# Words of the usual Latin filler, and keyboard filler.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
KEYBOARD = frozenset("foo bar baz qux quux qwerty qwertz azerty asdf jkl asdfgh zxcv zxcvb bla blah blabla abc abcd xyz xxx xxxx xx aaa bbb test tests testing dummy filler sample text content".split())

# Weak labels: how a notice, a status line or a filler sentence opens.
_STATUS = r"(?:http|error|status(?: ?code)?|code|fehler(?:code)?|statuscode|serverfehler|erreur|código|codigo|ошибка|код|错误|server message|request failed|runtime error|notice|warning|hinweis|avis|aviso|внимание|提示|o+ps|whoops,? something went wrong|something went wrong)"
_OPENINGS = re.compile("^(?:" + "|".join([
    rf"{_STATUS}\W*[1-5]\d\d\b", r"[45]\d\d\W+(?:\w+\W+){0,5}(?:not found|unavailable|forbidden|unauthori[sz]ed|denied|error|expired|timed out|gateway|requests)",
    r"(?:404|403|401|500|502|503|504|429)\W*$", rf"{_STATUS}\W*[:\-–—]\W*\w", r"(?:o+ps|whoops)\b", r"(?:internal )?server error", r"(?:page )?not found\W", r"(?:please )?(?:enable|activate|allow|turn on|switch on|accept) (?:javascript|java script|scripts?|scripting|cookies|active content)",
    r"(?:javascript|scripts?|scripting|cookies)(?: and (?:scripts?|cookies|javascript))? (?:is|are|must|has|have|need)", r"(?:to continue\W+|kindly |you must |you need to |you have to )(?:please )?(?:enable|activate|allow|turn on|switch on|accept)", r"fatal error", r"permission denied", r"the (?:resource|document|record|page|register|viewer|site|file) (?:you (?:are|requested|asked)|is (?:currently|momentarily|temporarily|no longer)|could not|was not|cannot)", r"this \w+ (?:requires|needs|uses) (?:javascript|scripts?|scripting|cookies|script support)", r"your (?:browser|session|connection)\b", r"you need an? (?:active|newer|modern)",
    r"(?:noscript\W+)?content is \w+ by script", r"(?:checking|verifying) (?:your browser|that you)", r"(?:please )?(?:prove|confirm|verify) (?:that )?you(?:'re| are)", r"if nothing happens", r"go back to the", r"(?:please )?try again", r"please (?:try|wait|reload|log in|sign in|contact|use)",
    r"contact the (?:site )?administrator", r"too many requests", r"access (?:to this \w+ )?(?:has been )?denied", r"(?:the )?service (?:is )?(?:currently |temporarily )?(?:unavailable|out of)", r"bad gateway", r"forbidden\W", r"you are not authori[sz]ed", r"something went wrong", r"unhandled exception", r"(?:the )?(?:database|backend) (?:connection|server)",
    r"an? (?:unexpected|internal) (?:\w+ )?error", r"(?:failed to|could not) (?:parse|render|load|open|read)", r"(?:the )?(?:requested )?(?:page|document|record) (?:you \w+ )?(?:could not be|cannot be|was not|does not|has been)", r"it may have been (?:renamed|moved|deleted)",
    r"bitte (?:aktivieren|erlauben|versuchen|warten)", r"ihr browser", r"javascript ist", r"diese \w+ benötigt (?:skripte|javascript|cookies)", r"ihre sitzung", r"die verbindung zu[rm]? (?:datenbank|server)", r"zugriff verweigert", r"der dienst ist", r"die angeforderte seite",
    r"veuillez (?:activer|autoriser|réessayer|patienter)", r"votre (?:navigateur|session)", r"cette \w+ a besoin des? (?:scripts|cookies|javascript)", r"accès refusé", r"le service est", r"la page demandée", r"la connexion (?:au serveur|à la base)", r"javascript est",
    r"(?:active|habilite|active|permita) (?:javascript|los scripts|las cookies)", r"su (?:navegador|sesión)", r"esta \w+ necesita (?:scripts|cookies|javascript)", r"acceso denegado", r"no se encontró la página", r"el servicio no", r"inténtelo de nuevo", r"se perdió la conexión", r"javascript está",
    r"(?:для просмотра \w+ )?(?:включите|разрешите) (?:javascript|скрипты|cookies)", r"для просмотра \w+ (?:включите|разрешите)", r"ваш браузер", r"ваша сессия", r"доступ запрещ", r"запрошенная страница", r"сервис временно", r"повторите попытку", r"соединение с",
    r"请(?:启用|开启|允许|稍后|重试)", r"您的浏览器", r"您请求的", r"访问被拒绝", r"服务暂时", r"(?:此|本)(?:页面|应用)需要", r"会话已",
    r"lorem ipsum", r"(?:this is )?(?:sample|dummy|placeholder|filler) (?:text|copy|paragraph|content)", r"your \w+ goes here", r"\w+ goes here\W*$", r"content will follow", r"this paragraph only holds", r"text text", r"blindtext", r"platzhalter", r"hier (?:entsteht|steht|folgt)", r"texte (?:de remplissage|à venir|d'exemple)", r"aquí (?:irá|va) el", r"texto de (?:relleno|ejemplo|muestra)",
    r"(?:здесь|тут) будет", r"текст-заполнитель", r"пример текста", r"示例文本", r"此处(?:为|将|填)", r"占位",
]) + ")", re.I)
# Words that such text shares with inventions that speak of it.
_TOPIC = re.compile(r"javascript|script|cookie|browser|navigateur|navegador|браузер|浏览器|\b[45]0\d\b|error|fehler|erreur|ошибк|错误|server|servidor|serveur|lorem|ipsum|placeholder|filler|template|\{\{|\$\{|%\w+%|login|session|timeout|captcha", re.I)
_PART = re.compile(r"[(（]\d+[)）]")


@dataclass(frozen=True)
class ResidueModel:
    weights: np.ndarray  # hashed n-grams, then dense features, then bias
    threshold: float  # best F1 on the weak labels of the hosts trained on; a segment that reaches it is residue


class Segment(NamedTuple):
    text: str
    kind: int  # 1 the first line, 2 a window round a template mark, 0 any other sentence or line
    mark: str = ""  # the template mark of a window


def mark_words(mark: str) -> list[str]:
    """Words of the name inside a template mark, without template keywords and numbers."""
    inner = re.sub(r"(?i)^<%=?\s*doc\.|^\{%\s*block", "", mark)
    return [w.rstrip("0123456789") for w in re.split(r"[\W_]+", inner.lower()) if w.rstrip("0123456789") and w not in ("lt", "gt")]


def segments(text: str) -> list[Segment]:
    out = []
    first = text.split("\n", 1)[0] if text else ""
    for piece in _CUT.split(text):
        if piece and not piece.isspace():
            out.append(Segment(piece, 1 if len(out) == 0 and piece == first else 0))
    if any(c in text for c in "{$#<[@_%&") or "goes here" in text or "TODO" in text:
        for m in MARK.finditer(text):
            if not _SPECIAL.match(m[0]):
                left = text[max(0, m.start() - 40) : m.start()].rsplit("\n", 1)[-1].split(" ")[-4:]
                right = text[m.end() : m.end() + 40].split("\n", 1)[0].split(" ")[:4]
                out.append(Segment(f"{' '.join(left)}{m[0]}{' '.join(right)}", 2, m[0]))
    return out


def weak_label(segment: Segment, text: str) -> int:
    """1 residue, -1 none, 0 unknown: what the training is told; scoring does not see it."""
    piece, kind, mark = segment
    if kind == 2:
        own = mark_words(mark)
        known = sum(w in FIELDS for w in own)
        if known and known >= len(own) - 1:
            return 1
        spoken = not known and own and len(re.findall(rf"\b{re.escape(own[0])}\b", text, re.I)) > 1
        return -1 if spoken else 0
    if "(" in piece and not _SPECIAL.search(piece) and _PART.search(piece):
        return -1 if _TOPIC.search(piece) else 0
    plain = piece if piece.isascii() else unicodedata.normalize("NFKC", piece)
    body = _LEAD.sub("", _NUMBERED.sub("", plain))
    if _SPECIAL.search(body):
        return -1
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", body)]
    if _OPENINGS.match(body) and not _PART.search(body):
        return 1
    if len(words) >= 3 and not _PART.search(body):
        if sum(w in LATIN for w in words) >= 0.7 * len(words) or len(words) >= 4 and sum(w in KEYBOARD for w in words) >= 0.7 * len(words):
            return 1
        if len(words) >= 6 and len(set(words)) <= 0.3 * len(words):
            return 1
    if _TOPIC.search(body):
        return -1 if _PART.search(body) or re.search(r"(?<=[a-zà-ÿ,] )(?!Java|Script|Skript|Cookie|Noscript|Browser|Seite|Dokument|Daten|Server|Error|Not|Found)[A-ZÀ-Ý][a-z]{3,}", body) else 0
    return 0


class _Hashes(dict):
    """Token -> hash of its folded form, all numbers alike; filled on demand and bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        folded = "0" if token[0].isdigit() else unicodedata.normalize("NFKC", token).casefold()
        found = self[token] = zlib.crc32(folded.encode("utf-8", "replace"))
        return found


_hash = _Hashes().__getitem__
_tokens = _TOKEN.findall


def _ids(tokens: list[str]) -> list[int]:
    return list(map(_hash, tokens))


def _mark_ids(mark: str) -> list[int]:
    """Words of a mark, apart from the same words in prose, and its shape."""
    return _ids(["\x01" + w for w in mark_words(mark)] + ["\x02" + re.sub(r"\w[\w. ]*", "n", mark)])


def features(parts: list[Segment], titles: list[frozenset[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each n-gram, its hash, dense features): words and pairs of neighbouring words, in a mark's window the
    words of the mark once more; for each segment its length, the share of different words, whether it is the first
    line or a mark's window, its words in the title, whether it is very short, and how much a longer one repeats."""
    ids, sizes, rows = [], [], []
    for (segment, kind, mark), title in zip(parts, titles):
        own = _ids(_tokens(_NUMBERED.sub("", segment) if kind == 0 and not segment[0].isalpha() else segment))
        n, kinds = len(own), set(own)
        if kind == 2:
            own += _mark_ids(mark)
        ids += own
        sizes.append(len(own))
        rows.append((n, len(kinds), kind, len(kinds & title)))
    shape = np.array(rows, np.float32).reshape(-1, 4)
    n, kinds, kind, shared = shape.T
    different = kinds / np.maximum(n, 1)
    dense = np.stack([np.log1p(n) / 4, different, kind == 1, kind == 2, shared / np.maximum(kinds, 1), n <= 3, (n >= 6) * np.maximum(0.5 - different, 0) * 4], axis=1).astype(np.float32)
    where = np.repeat(np.arange(len(parts)), sizes)
    a, at = np.array(ids, np.uint64), where
    both = at[1:] == at[:-1] if len(at) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pairs = (a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    mask = np.uint64((1 << BITS) - 1)
    return np.concatenate([at, at[1:][both]]), np.concatenate([a & mask, (pairs & mask)[both]]).astype(np.int64), dense


def scores(weights: np.ndarray, at: np.ndarray, grams: np.ndarray, dense: np.ndarray) -> np.ndarray:
    n = len(dense)
    count = np.bincount(at, minlength=n)
    total = np.bincount(at, weights=weights[grams], minlength=n)
    return total / np.sqrt(np.maximum(count, 1)) + dense @ weights[1 << BITS : (1 << BITS) + DENSE] + weights[-1]


def train(at: np.ndarray, grams: np.ndarray, dense: np.ndarray, labels: np.ndarray, l2: float = 1e-5, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Logistic regression with an L2 penalty on the given features, full-batch Adam; both classes weigh the same."""
    n = len(labels)
    y = (labels > 0).astype(np.float64)
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))
    seen, grams = np.unique(grams, return_inverse=True)  # the weight of an n-gram without a segment stays 0
    k = len(seen)
    w = np.zeros(k + DENSE + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        x = np.bincount(at, weights=w[grams], minlength=n) * scale + dense @ w[k:-1] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y) * balance
        g = np.concatenate([np.bincount(grams, weights=(e * scale)[at], minlength=k), e @ dense, [e.sum()]]) + l2 * w
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    full = np.zeros((1 << BITS) + DENSE + 1)
    full[seen] = w[:k]
    full[1 << BITS :] = w[k:]
    return full


def _title(text: str) -> frozenset[int]:
    return frozenset(_ids(_TOKEN.findall(text.split("\n", 1)[0])))


_SAMPLE = "host string, label int, grams array<int>, dense array<float>, place long"


def labelled_sample(docs: DataFrame, key: str, text: str, host: str, sample_docs: int, sample_segments: int) -> DataFrame:
    """Features of weakly labelled segments of about sample_docs documents (by hash of the key), sample_segments at most:
    (host, label, grams, dense, place). Unlabelled segments of documents without any positive one serve as negatives, one in
    thirty. The features are computed where the documents are read, from whole segments."""
    n = docs.count()
    share = max(1, -(-n // sample_docs))
    picked = docs.filter(F.col(text).isNotNull() & (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(share)) == 0)).select(F.col(host).cast("string").alias("host"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, labels, parts, titles, places = [], [], [], [], []
            for host_name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [(s, weak_label(s, t)) for s in segments(t)]
                clean = not any(label > 0 for _, label in own)
                first = t.split("\n", 1)[0]
                title = _title(t)
                for s, label in own:
                    place = zlib.crc32(f"{first}{s.text}".encode("utf-8", "replace"))
                    if label or clean and place % 30 == 0:
                        hosts.append(host_name or "")
                        labels.append(label or -1)
                        parts.append(s)
                        titles.append(title)
                        places.append(place << 31 | zlib.crc32(f"{host_name}|{label}|{s}".encode("utf-8", "replace")) >> 1)
            at, grams, dense = features(parts, titles)
            order = np.argsort(at, kind="stable")
            ends = np.concatenate([[0], np.bincount(at, minlength=len(parts)).cumsum()]).astype(np.int32)
            columns = [pa.array(hosts, pa.string()), pa.array(labels, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[order].astype(np.int32))),
                       pa.ListArray.from_arrays(pa.array(np.arange(0, dense.size + 1, DENSE, dtype=np.int32)), pa.array(dense.ravel())), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "label", "grams", "dense", "place"])

    return spread(picked).mapInArrow(run, _SAMPLE).orderBy("place").limit(sample_segments)


def unseen(host: str) -> bool:
    """Hosts held out for validation: about one in four."""
    return zlib.crc32(host.encode()) % 4 == 0


_MODEL = "weights binary, threshold double, train_segments long, train_positive long, unseen_segments long, unseen_positive long, precision double, recall double"


def _fitted(sample: pa.Table) -> pa.Table:
    """One row of _MODEL from the rows of labelled_sample."""
    sample = sample.sort_by("place")
    hosts, y = sample.column("host").to_pylist(), sample.column("label").to_numpy()
    dense = np.array(sample.column("dense").to_pylist(), np.float32).reshape(-1, DENSE)
    lists = sample.column("grams").combine_chunks()
    sizes, grams = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(y)), sizes)
    held = np.array([unseen(h) for h in hosts], bool)
    if held.all():
        held[:] = False

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = mask[at]
        return (np.cumsum(mask) - 1)[at[inside]], grams[inside], dense[mask]

    report = {"train_segments": int((~held).sum()), "train_positive": int((y[~held] > 0).sum()), "unseen_segments": int(held.sum()), "unseen_positive": int((y[held] > 0).sum()), "precision": None, "recall": None}
    weights, threshold = np.zeros((1 << BITS) + DENSE + 1), np.inf
    if (y[~held] > 0).any() and (y[~held] < 0).any():
        known = part(~held)
        weights = train(*known, y[~held])
        own, true = scores(weights, *known), y[~held] > 0
        order = np.argsort(-own, kind="stable")
        f1 = 2 * np.cumsum(true[order]) / (np.arange(1, len(own) + 1) + true.sum())
        best = int(f1.argmax())
        threshold = float((own[order[best]] + own[order[min(best + 1, len(own) - 1)]]) / 2)
        if held.any():
            got, true = scores(weights, *part(held)) >= threshold, y[held] > 0
            report["precision"] = float((got & true).sum() / max(1, got.sum()))
            report["recall"] = float((got & true).sum() / max(1, true.sum()))
            weights = train(at, grams, dense, y)
    row = {"weights": [weights.astype(np.float32).tobytes()], "threshold": [threshold], **{k: [v] for k, v in report.items()}}
    kinds = {"weights": pa.binary(), "precision": pa.float64(), "recall": pa.float64()}
    return pa.table({k: pa.array(v, kinds.get(k)) for k, v in row.items()})


def fit_table(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", sample_docs: int = SAMPLE_DOCS, sample_segments: int = SAMPLE_SEGMENTS) -> DataFrame:
    """The model as a table of one row, to be written and loaded: weights, threshold, counts, and precision and recall against
    the weak labels on unseen hosts. The bounded sample is fitted in one task of an executor; what reaches the driver is that
    row (1 MB), whatever the size of docs. An empty table gives no row."""
    return labelled_sample(docs, key, text, host, sample_docs, sample_segments).groupBy(F.lit(0).alias("__all")).applyInArrow(_fitted, _MODEL)


def load(table: DataFrame) -> tuple[ResidueModel, dict]:
    """(model, report) of a table written from fit_table. Without labels of both kinds, or without a row, the model flags
    nothing."""
    names = table.columns[2:]
    row = table.first()
    if row is None:
        return ResidueModel(np.zeros((1 << BITS) + DENSE + 1, np.float32), np.inf), {n: None if n in ("precision", "recall") else 0 for n in names}
    return ResidueModel(np.frombuffer(row.weights, np.float32), row.threshold), {n: row[n] for n in names}


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", sample_docs: int = SAMPLE_DOCS, sample_segments: int = SAMPLE_SEGMENTS) -> tuple[ResidueModel, dict]:
    """(model, report) by way of a staged model table."""
    return load(staged(fit_table(docs, key, text, host, sample_docs, sample_segments), "residue-model"))


def flagged_texts(texts: list[str], model: ResidueModel) -> np.ndarray:
    """For each text whether the score of one of its segments reaches the threshold."""
    keep = np.zeros(len(texts), bool)
    for start in range(0, len(texts), 64):
        parts, titles, owner = [], [], []
        for i, t in enumerate(texts[start : start + 64]):
            own = segments(t)
            parts += own
            titles += [_title(t)] * len(own)
            owner += [start + i] * len(own)
        if parts:
            keep[np.array(owner)[scores(model.weights, *features(parts, titles)) >= model.threshold]] = True
    return keep


def find_residue(docs: DataFrame, model: ResidueModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key): documents with at least one segment whose score reaches the threshold. All
    segments of whole texts are scored; null, empty and blank texts have none. Narrow: no shuffle; repeated keys come
    out as often as they are flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = flagged_texts(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=[key])

    rows = spread(docs.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)))
    return rows.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}")
