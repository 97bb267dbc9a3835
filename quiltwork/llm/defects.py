"""Broken prompt and response pairs: empty, truncated, refusal, copied, other_language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.functions.text import has_text
from quiltwork.llm.canonical import fold, words
from quiltwork.llm.language import language
from quiltwork.llm.pushdown import code_breaks_off, is_code, list_breaks_off, list_items, prose_breaks_off, unclosed
from quiltwork.llm.tiling import tiles
from quiltwork.session import spread

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")

# Words that stand in for a missing value.
STAND_INS = frozenset("""n a|na|none|null|nil|nan|nul|undefined|missing|blank|empty|void|no answer|no response|no data|no value|not available|not applicable|not given|not provided|no output
keine angabe|k a|leer|keine antwort|fehlt|entfällt|aucune réponse|aucun|vide|sans réponse|non disponible|sin respuesta|ninguno|ninguna|vacío|no disponible|нет|нет ответа|нет данных|пусто|无|暂无|空|没有答案|tbd|tba|empty string|answer missing|response missing""".replace("\n", "|").split("|"))

_ASKS_COPY = re.compile(r"\b(?:repeat|copy|copies|quote|verbatim|word for word|exactly as (?:it|they)|return all of it|spelling|proofread|retype|transcribe|wiederhole|abschreib|zitier|rechtschreib|kopier|répét\w+|recopi\w+|copi\w+|cit(?:ez|e|er)\b|orthograph\w+|repit\w+|copia\w*|cita\b|citar|ortograf\w+)", re.I)
_ASKS_TRANSLATION = re.compile(r"\b(?:translat\w+|render (?:this|the|it)|(?:in|into|to) (?:german|french|spanish|english|russian|chinese|italian|portuguese|dutch|japanese|korean|arabic)|übersetz\w*|übertrag\w*|auf (?:deutsch|englisch|französisch|spanisch|russisch)|ins (?:deutsche|englische|französische|spanische|russische)|tradui\w+|traduc\w+|traduz\w+|en (?:anglais|allemand|français|espagnol|russe|inglés|alemán|francés|español|ruso)|al (?:inglés|alemán|francés|español|ruso)|перевед\w+|翻译|译成)", re.I)
_ASKS_DECLINE = re.compile(r"\b(?:declin\w+|turn(?:s|ing)? down|refus\w+|reject\w*|regret\w*|say(?:ing)? no|apolog\w+|ablehn\w+|absag\w+|lehnt|declin\w+|rechaz\w+|décliner?|отказ\w*)", re.I)
_LETTER_START = re.compile(r"\W*(?:dear|hello|hi|thank you|thanks|to whom|liebe[rs]?|hallo|sehr geehrte|cher|chère|bonjour|merci|estimad[oa]|querid[oa]|hola|gracias)\b", re.I)

_TASK = r"(?:task|request|question|prompt|query|instruction|this|that|it|here|you|one)"
# The grammar of refusals: optional regret or self-description, then a first-person or impersonal core that declines.
_OPENING = r"(?:(?:i[' ]?a?m (?:very |so |truly )?(?:sorry|afraid)|(?:my )?apolog\w+|i apologi[sz]e|sorry|unfortunately|regrettably|i regret(?: that)?|as an? [\w\s-]{0,30}?(?:assistant|model|ai|bot|system|program)|es tut mir leid|leider|entschuldigung|bedauerlicherweise|je suis (?:vraiment )?désolée?|désolée?|malheureusement|je regrette|lo siento(?: mucho)?|lamentablemente|desafortunadamente|por desgracia|disculpe|к сожалению|извините|простите|很抱歉|抱歉|对不起)\W*(?:(?:but|however|aber|mais|pero|that|dass|que|но|但)\b\W*)?)*"
_CORES = [
    rf"i ?(?:can ?not|can ?'?t|cant|am (?:un|not )able to|am not (?:permitted|allowed|in a position|authori[sz]ed|equipped) to|will not|won ?'?t|wont|would rather not|'?d (?:rather|prefer to) not|'?d prefer not|must (?:decline|refuse)|have to (?:decline|refuse|skip|pass|turn)|do ?n[o']? ?t have (?:the |any )?(?:means|ability|capacity|permission)|do not have (?:the |any )?(?:means|ability|capacity|permission)|lack the|decline to|refuse to|am going to (?:decline|pass|skip))\b",
    r"you (?:will|'?ll|would|may) need to ask (?:some|any)\w+",
    r"no (?:answer|reply|response|help) to (?:this|that|it)[\w\s]* can be (?:given|offered|provided)",
    r"it is (?:im|not )possible for me to",
    r"(?:this|that|it|your \w+) (?:is|falls|lies|goes) (?:outside|beyond)(?: of)? (?:my|the things i|what i)",
    r"my (?:\w+ )?(?:settings|guidelines|rules|polic\w+|instructions|programming) (?:do ?n[o']? ?t|do not|forbid|prevent|prohibit)",
    r"(?:ich )?(?:dazu |hier |dabei |das )?(?:kann|darf|möchte|werde)(?: ich)? (?:[\w\s]{0,40}?)(?:nicht|nichts|kein\w*)\b",
    r"ich bin nicht (?:in der lage|befugt|berechtigt)", r"ich (?:muss|möchte) (?:[\w\s]{0,40}?)ablehnen", r"ich lehne (?:[\w\s]{0,30}?)ab",
    r"(?:il )?m ?'?est (?:malheureusement )?impossible de", r"je (?:ne |n ?')(?:peux|saurais|suis|puis|veux)[\w\s]{0,20}? ?pas", r"je dois (?:décliner|refuser|passer)",
    r"je (?:décline|refuse)\b", r"(?:cela|ceci|c ?'est) (?:dépasse|sort|hors)",
    r"no (?:me es posible|puedo|podré|estoy (?:autorizad|en condiciones)|tengo permitido|voy a (?:poder )?(?:responder|contestar))", r"(?:debo|tengo que) (?:declinar|rechazar|negarme)", r"me es imposible", r"me niego a",
    r"я не (?:могу|буду|имею|вправе|в состоянии)", r"не могу (?:ответить|помочь|выполнить)", r"вынужден\w* отказать", r"(?:我)?(?:无法|不能|不便|没办法|拒绝)(?:回答|帮助|完成|处理|提供|协助|为您)?",
]
_REFUSAL = re.compile(rf"^\W*{_OPENING}(?:{'|'.join(_CORES)})", re.I)
_ABOUT_TASK = re.compile(rf"\b(?:answer\w*|repl(?:y|ies)|respond\w*|assist\w*|write|discuss|complete|remit|handle|{_TASK[3:-1]}|aufgabe|frage|anfrage|helfen|weiterhelfen|auskunft|dazu|hier|dabei|bearbeiten|beantworten|demande|tâche|question|répondre|traiter|aider|tarea|pregunta|solicitud|petición|responder|contestar|ayudar|atender)\b|вопрос|задач|запрос|回答|问题|请求|任务|帮", re.I)
# A sentence of courtesy that may stand before a refusal, and words of one who speaks about asking and answering.
_COURTESY = re.compile(r"\W*(?:thank you|thanks|hello|hi|i (?:understand|appreciate|see)|danke|vielen dank|hallo|ich verstehe|merci|bonjour|je comprends|gracias|hola|entiendo|спасибо|здравствуйте|谢谢|您好|你好)\b[^.!?。]*[.!?。]?\s*$", re.I)
_PERSONAL = re.compile(r"\b(?:i|me|my|you|your|please|sorry|thanks?|feel free|ask\w*|contact|consult|frag\w*|demand\w*|pregunt\w*|ich|mir|mich|mein\w*|sie|ihnen|ihr\w*|bitte|danke|entschuldigung|je|j|moi|mon|ma|mes|vous|votre|vos|merci|désolée?|yo|mi|mis|me|usted|tú|su|por favor|gracias|perdón|lo siento)\b|\b(?:я|мне|мой|вы|вам|ваш\w*|пожалуйста|спасибо|извините)\b|[我您你请]", re.I)
_NUMBERS = {w: n for n, ws in enumerate([(), (), ("two", "zwei", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"), ("ten", "zehn", "dix", "diez")]) for w in ws}
_ASKED = re.compile(rf"\b(?:list|name|give|write|nenne|liste|citez|donnez|enumera|nombra|da)\b\W+(?:\w+\W+){{0,2}}?(\d{{1,2}}|{'|'.join(_NUMBERS)})\b(?!\W*(?:sentence|phrase|sätze|frase))", re.I)


def is_empty(folded: str, asked: str) -> bool:
    """Nothing visible, only marks, or a stand-in for a missing value that the question does not offer as an answer."""
    own = words(folded)
    if not own:
        return True
    said = " ".join(own)
    return len(own) <= 3 and said in STAND_INS and f" {said} " not in f" {' '.join(words(asked))} "


def is_refusal(folded: str, asked: str) -> bool:
    """The text opens with a refusal, but for courtesies, and is little else: the sentences that neither decline nor speak
    of the one who asks or answers have at most as many words as the others, whatever the length. Where a declining note is asked for, only
    a refusal of the task itself counts: no letter, and words about answering or the task."""
    plain = folded.replace("’", "'")
    said = [x for x in re.split(r"(?<=[.!?。！？])\s*", plain) if words(x)]
    start = next((k for k, x in enumerate(said) if not _COURTESY.match(x)), len(said))
    if start == len(said) or not _REFUSAL.match(said[start]) or not _ABOUT_TASK.search(said[start]):
        return False
    if _ASKS_DECLINE.search(asked) and _LETTER_START.match(plain):
        return False
    size = [len(words(x)) for x in said]
    beside = sum(n for n, x in zip(size, said) if not (_REFUSAL.match(x) or _PERSONAL.search(x)))
    return 2 * beside <= sum(size)


def _parts(text: str) -> list[list[str]]:
    """Words of what may be the passage: the whole, and the whole without its first or its last line."""
    lines = [x for x in text.split("\n") if re.search(r"[^\W_]", x)]
    out = [words(text)]
    if len(lines) > 1:
        out += [words("\n".join(lines[1:])), words("\n".join(lines[:-1]))]
    return out


def copy_of(folded: str, asked: str) -> bool:
    """Nearly all of the answer is nearly all of the question or its passage."""
    own = words(folded)
    whole = words(asked)
    if len(own) < 6 or len(own) < 0.4 * len(whole):
        return False
    have = set(whole)
    if sum(w in have for w in own) < 0.8 * len(own):
        return False
    pairs = set(zip(whole, whole[1:]))
    both = [p in pairs for p in zip(own, own[1:])]
    if sum(map(max, [*both, False], [False, *both])) < 0.82 * len(own):  # tiles lie in common pairs of words
        return False
    found = tiles(own, whole, 2)
    covered = sum(n for _, _, n in found)
    if covered < 0.82 * len(own):
        return False
    marks = [False] * len(whole)
    for _, j, n in found:
        marks[j : j + n] = [True] * n
    hit = sum(marks)
    lines = [x for x in asked.split("\n") if re.search(r"[^\W_]", x)]
    if hit >= 0.85 * len(whole):
        return True
    if len(lines) < 2:  # line ends are lost: the instruction is a run at one end
        return hit >= 0.6 * len(whole)
    first, last = len(words(lines[0])), len(words(lines[-1]))
    return sum(marks[first:]) >= 0.8 * (len(whole) - first) and len(whole) - first >= 6 or sum(marks[: len(whole) - last]) >= 0.8 * (len(whole) - last) and len(whole) - last >= 6


def is_truncated(text: str, folded: str, asked: str) -> bool:
    """Code, a list or prose that breaks off. Single words and phrases taken from the question are labels, not prose;
    a text that ends where a line of the question ends has as much of an end as the question has."""
    if is_code(text):
        return code_breaks_off(text)
    items = list_items(folded)
    if items is not None:
        if unclosed(folded):
            return True
        m = _ASKED.search(" ".join(asked.split()))
        return list_breaks_off(items, (int(m[1]) if m[1].isdigit() else _NUMBERS[m[1].lower()]) if m else None)
    own = words(folded)
    if not prose_breaks_off(folded):
        return False
    if re.search(r"[^\W_]", folded) and len(own) < 2 and not re.search(r"[一-鿿]{4}", folded):
        return False
    said = " ".join(own)
    if len(own) <= 4 and f" {said} " in f" {' '.join(words(asked))} ":
        return False
    if re.search(r"[(,\[{–—-]\s*$|…\W*$|\.\.\.\W*$", folded.rstrip()) or unclosed(folded):
        return True
    return not any(" ".join(words(line)).endswith(said) for line in [*asked.split("\n"), asked]) if len(own) > 4 else True


def classify(inputs: str, targets: str | None) -> str | None:
    """The first defect of a pair that holds, or None."""
    asked = fold(inputs)
    wish = " ".join(asked.split())  # the question on one line, for what it asks
    folded = fold(targets) if targets else ""
    if is_empty(folded, asked):
        return "empty"
    copied = copy_of(folded, asked)
    if is_truncated(targets, folded, asked) and not (copied and not prose_tail_cut(folded)):
        return "truncated"
    if is_refusal(" ".join(folded.split()), wish):
        return "refusal"
    if copied and not _ASKS_COPY.search(wish):
        return "copied"
    if is_code(targets) or list_items(folded) is not None or len(words(folded)) < 4 and not re.search(r"[一-鿿Ѐ-ӿ]", folded):
        return None
    spoken = language(folded, 1.5)
    if spoken is None or _ASKS_TRANSLATION.search(wish):
        return None
    heard = language(asked)
    return "other_language" if heard is not None and heard != spoken else None


def prose_tail_cut(folded: str) -> bool:
    """The end itself shows the cut (an opening mark or an ellipsis)."""
    return bool(re.search(r"[(,\[{–—-]\s*$|(?<!\.)\.\.\.\W*$|…\W*$", folded.rstrip()))


def find_defects(rows: DataFrame, key: str = "row_id", inputs: str = "inputs", targets: str = "targets") -> DataFrame:
    """(key, defect) of every defective pair among rows that are objects with non-blank inputs.

    Narrow: one pass over the three columns, whole texts, no shuffle. Rows without a defect do not come out; repeated
    rows and keys come out as often as they occur.
    """
    own = rows.filter(F.coalesce("is_object", F.lit(False)) & has_text(F.col(inputs))) if "is_object" in rows.columns else rows.filter(has_text(F.col(inputs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = pa.array([x is not None for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([x for x in found if x], pa.string())], names=[key, "defect"])

    kind = dict(rows.dtypes)[key]
    return spread(own.select(F.col(key), F.col(inputs), F.col(targets))).mapInArrow(run, f"`{key}` {kind}, defect string")
