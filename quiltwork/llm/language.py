"""Script and function-word checks that tell in which language a short text is written."""

from __future__ import annotations

import re

_LETTER = re.compile(r"[^\W\d_]+")
_HAN, _KANA, _HANGUL, _CYRILLIC = (re.compile(f"[{r}]") for r in ("一-鿿", "぀-ヿ", "가-힯", "Ѐ-ӿ"))

# Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for it with as his on be at by had not are but from or have an they which you were her she there would their we him been has when who will more no if out so what up said its about than into them can only other could this these any nobody each every after before between although because while why where",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine einer einem einen als auch es an werden aus er hat dass daß sie nach wird bei um am sind noch wie über zum war haben nur oder aber vor zur bis mehr durch man sein wurde wurden sei wenn wieder so niemand warum jeden obwohl laut zwischen jahr ich kann diese",
    "fr": "le la les de des du un une et à est en que qui dans pour pas au sur ne se ce il elle sont plus par avec son sa ses mais comme ou si leur y été a était cette ces aux nous vous je car après avant entre selon quand souvent aussi personne savait pourquoi chaque seulement d l n s qu",
    "es": "el la los las de del un una y a en que es por con para se no al lo como más su sus pero o este esta fue ha había era son sin sobre también entre cuando muy según porque desde hasta nadie sabía cada antes después solamente menudo donde yo puedo",
    "it": "il lo la i gli le di del della che e è un una in per non con si da come più ma anche sono nel alla dei delle al dal questo questa suo sua ha era perché quando ogni dopo prima tra",
    "pt": "o a os as de do da dos das um uma e é em que para com não por no na se mais como mas foi ao ele sua seu ou quando muito nos já também pela pelo até isso entre depois sem cada",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij dan nog naar uit door over ze hij wordt werd waren deze die heeft",
}
# Days and months.
CALENDAR = {
    "en": "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december spring summer autumn winter",
    "de": "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "lunedì martedì mercoledì giovedì venerdì sabato domenica gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "segunda terça quarta quinta sexta sábado domingo janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag januari februari maart april mei juni juli augustus september oktober november december",
}
_SETS = {k: frozenset(v.split()) | frozenset(CALENDAR[k].split()) for k, v in FUNCTION_WORDS.items()}
_OWNERS: dict[str, tuple[str, ...]] = {}
for _lang, _words in _SETS.items():
    for _word in _words:
        _OWNERS[_word] = (*_OWNERS.get(_word, ()), _lang)
# Letters that point to a language on their own.
_MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ó": "es", "í": "es", "ú": "es", "è": "fr", "ê": "fr", "ç": "fr", "à": "fr", "û": "fr", "î": "fr", "ô": "fr", "œ": "fr"}


def script_language(folded: str) -> str | None:
    """Language of a non-Latin script that carries much of the text."""
    if folded.isascii():
        return None
    letters = sum(map(len, _LETTER.findall(folded)))
    if not letters:
        return None
    if len(_CYRILLIC.findall(folded)) > 0.3 * letters:
        return "ru"
    if len(_KANA.findall(folded)) > 0.15 * letters:
        return "ja"
    if len(_HANGUL.findall(folded)) > 0.3 * letters:
        return "ko"
    if len(_HAN.findall(folded)) > 0.25 * letters:
        return "zh"
    return None


def language(folded: str, least: float = 1.2) -> str | None:
    """Language of a folded text, None where too few words speak for one.

    A function word counts for each language that has it, a word of one language alone twice; the best language must
    reach least and 1.4 times the second.
    """
    if (found := script_language(folded)) is not None:
        return found
    score: dict[str, float] = {}
    for word in _LETTER.findall(folded):
        own = _OWNERS.get(word)
        if own:
            gain = 2.0 if len(own) == 1 else 1.0 / len(own)
            for lang in own:
                score[lang] = score.get(lang, 0.0) + gain
    if not folded.isascii():
        for c in folded:
            if (lang := _MARKS.get(c)) is not None:
                score[lang] = score.get(lang, 0.0) + 0.5
    if not score:
        return None
    best = max(score, key=score.__getitem__)
    second = max((v for k, v in score.items() if k != best), default=0.0)
    return best if score[best] >= least and score[best] >= 1.4 * second else None
