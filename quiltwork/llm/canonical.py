"""Canonical form of a record: what is left once formatting and the order of labelled fields are disregarded."""

from __future__ import annotations

import hashlib
import re
import unicodedata

# A word: letters and digits, with a decimal mark only where it stands between two digits.
_WORD = re.compile(r"\d+(?:[.,]\d+)+|[^\W_]+")
_SPACE = r"[^\S\n]*"
_QUOTE = "\"'‘’‚“”„«»`*"
# Label, then one of the marks that may stand between a label and its value, strongest first. A dash also stands in
# prose, so before a dash a label must open the text, a line or a field.
_MARKS = (":", "=", "—", "–", "-")
_OPEN = rf"(?:^|(?<=[\n|;,{{}}\[(.?!–—-]))\s*[{_QUOTE}•-]*{_SPACE}[{_QUOTE}]?"
_NAME = r"([^\W\d_][^\W_]*(?:_[^\W_]+)*)"
_LABELS = [re.compile(rf"(?<![\w.,]){_NAME}[{_QUOTE}]?\s*{m}" if m in ":=" else rf"{_OPEN}{_NAME}[{_QUOTE}]?{_SPACE}{m}(?!\w)") for m in _MARKS]
SURE_FIELDS = 3
_BODY = re.compile(r"[^\W_]")


def fold(text: str) -> str:
    """Compatibility form, case folded, composed."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def words(folded: str) -> list[str]:
    return _WORD.findall(folded)


def _labels(folded: str) -> tuple[list[re.Match], bool]:
    """The labels of what may be a record of at least two different labelled fields (else none), and whether it surely is one: at
    least SURE_FIELDS fields with short values. Two colons or long values may stand in prose as well."""
    loose: list[re.Match] = []
    for pattern, mark in zip(_LABELS, _MARKS):
        if folded.count(mark) < 2:
            continue
        found = list(pattern.finditer(folded))
        if len(found) >= 2 and len({m[1] for m in found}) == len(found):
            if len(found) >= SURE_FIELDS and _adjacent(folded, found):
                return found, True
            loose = loose or found
    return loose, False


def _adjacent(folded: str, found: list[re.Match]) -> bool:
    return all(len(folded[a.end() : b.start()].split()) <= 12 for a, b in zip(found, found[1:]))


def _closed(body: str) -> tuple[str, str] | None:
    """The parts before and behind the brace or bracket that closes the record (none that opens behind the label), if words
    follow it."""
    for mark, stop in ("{}", "[]"):
        depth = 0
        for m in re.finditer(rf"[\{mark}\{stop}]", body):
            depth += 1 if m[0] == mark else -1
            if depth < 0:
                if _BODY.search(body[m.end() :]):
                    return body[: m.start()], body[m.end() :]
                break
    return None


def split_tail(folded: str, tails: frozenset[str] = frozenset()) -> tuple[str, str]:
    """Last value of a record and the words behind the record.

    The value ends at a closing brace or bracket or at its line's end; where line ends became plain white space, at
    the place from which the rest is one of the known tails.
    """
    body = folded.lstrip()
    if closed := _closed(body):
        return closed
    lines = [x for x in body.split("\n") if _BODY.search(x)]
    if len(lines) > 1 and not tails or len(lines) == 2:
        return lines[0], "\n".join(lines[1:])
    if tails:
        own = words(body)
        for k in range(1, len(own)):
            if " ".join(own[k:]) in tails:
                return " ".join(own[:k]), " ".join(own[k:])
    return body, ""


def canonical_inputs(text: str, tails: frozenset[str] = frozenset()) -> str:
    """Words in order, joined without white space; the fields of a record sorted by label, in the place of the record."""
    folded = fold(text)
    found, sure = _labels(folded)
    if not sure:
        return "".join(words(folded))
    head = folded[: found[0].start()]
    values = [folded[a.end() : b.start()] for a, b in zip(found, found[1:])]
    last, tail = split_tail(folded[found[-1].end() :], tails)
    fields = sorted(f"{m[1]}\x01{''.join(words(v))}" for m, v in zip(found, [*values, last]))
    return f"{''.join(words(head))}\x02{'\x03'.join(fields)}\x02{''.join(words(tail))}"


def canonical_text(text: str) -> str:
    """Words in order, joined without white space; empty for a text of marks only."""
    return "".join(words(fold(text)))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=32).digest()


def _signed(raw: bytes) -> tuple[bytes, bytes]:
    """128-bit hash, and an independent 64-bit one for the collision check."""
    return hashlib.md5(raw, usedforsecurity=False).digest(), hashlib.blake2b(raw, digest_size=8).digest()


def _splits(label: str, own: list[str]) -> list[tuple[bytes, bytes]]:
    """Digests of the field and of the words behind the record, for each place at which the last value may end. Each word
    is hashed once from the left (field) and once from the right (the words behind it, read backwards)."""
    left, right = hashlib.blake2b(f"{label}\x01".encode("utf-8", "replace"), digest_size=32), hashlib.blake2b(digest_size=32)
    fields, rest = [], [right.digest()]
    for word in own:
        left.update(word.encode("utf-8", "replace"))
        fields.append(left.digest())
    for word in reversed(own[1:]):
        right.update(word[::-1].encode("utf-8", "replace"))
        rest.append(right.digest())
    return list(zip(fields, reversed(rest)))


def signatures_of(inputs: str, targets: str) -> tuple[tuple[bytes, bytes], bool, list[tuple[bytes, bytes]]]:
    """Signature of the pair, whether inputs may hold a record, and the ways to read it.

    A closing brace or bracket tells where the last value ends. Without one any
    word may be the last of the value: a line end does not tell, as copies lose and gain them. The signature then is that of
    the record as it stands, and there is one way for each place, with the signature of a record that ends there. What may be a
    record or prose (two fields, or long values) has the signature of its words in order, and the ways to read it as a record;
    a sure record with a known end has no other way (an empty list).
    """
    folded, answer = fold(inputs), _digest(canonical_text(targets))
    found, sure = _labels(folded)
    plain = lambda: _signed(b"\x00" + _digest("".join(words(folded))) + answer)
    if not found:
        return plain(), False, []
    head = _digest("".join(words(folded[: found[0].start()])))
    fields = [_digest(f"{a[1]}\x01{''.join(words(folded[a.end() : b.start()]))}") for a, b in zip(found, found[1:])]
    whole = lambda field, rest: _signed(b"\x02" + head + b"".join(sorted([*fields, field])) + rest + answer)
    label, body = found[-1][1], folded[found[-1].end() :].lstrip()
    own = words(body)
    if closed := _closed(body):
        value, rest = ("".join(words(x)) for x in closed)
        ends = [whole(_digest(f"{label}\x01{value}"), _digest(rest[::-1]))]
    elif len(own) < 2:
        ends = [whole(_digest(f"{label}\x01{''.join(own)}"), _digest(""))]
    elif sure:
        stands = _signed(b"\x04" + head + b"".join(sorted(fields)) + _digest(f"{label}\x01{' '.join(own)}") + answer)
        return stands, True, [whole(*x) for x in _splits(label, own)]
    else:
        ends = [whole(*x) for x in _splits(label, own)]
    return (ends[0], True, []) if sure else (plain(), True, ends)
