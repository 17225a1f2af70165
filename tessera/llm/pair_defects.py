"""Defects of question-answer pairs: empty, truncated, refusing, copying and wrong-language answers."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import counted_broadcast, materialize

#: A task hands on its counts of words when it holds so many; no word is lost by that.
FLUSH_WORDS = 200_000
#: Vote of a word whose language was learnt (function words have 1, shared by their languages).
LEARNT_VOTE = 0.7
#: A last word and a bare name, which are looked up in the record's other texts, have at most so many characters.
LAST_WORD = 200

# Function words by language. Words shared by several languages share their vote.
STOPWORDS = {
    "en": "the of and to is was were are it in on at by for with from as that this which who what whose an a be been not no yes or but its his her their there then when after before between because about would could had has have into than they he she both some any all says said does did how many more must where while will you your",
    "de": "der die das den dem des ein eine einen einem einer und ist war waren sind nicht kein keine von vom zu zum zur im in am an auf aus bei mit nach für über unter vor wurde wird werden hat haben hatte als auch sich es er sie wir ich dass weil denn wenn wie was wer welche welcher welches etwa durch oder aber noch nur so zwischen daraus hinter ja nein ergibt lautet laut gemäß unten oben unser unsere",
    "fr": "le la les l un une des du de d et est était sont a au aux en dans sur sous par pour avec sans ce cet cette ces c qui que qu quoi dont où il elle ils elles on nous vous je ne pas plus se s son sa ses leur leurs ou mais car comme selon environ entre avant après quand combien quelle quel oui non ainsi derrière bord été ont fut",
    "es": "el la los las un una unos unas y o de del al en es son era fue ser está con sin por para que qué quién como cómo cuando cuándo no sí se su sus lo le les este esta esto ese esa pero más muy entre desde hasta hacia según sobre porque antes después cuántos junto así trata ha han hay",
    "it": "il lo la i gli le un uno una di del della dello dei delle degli a al alla ai in nel nella è sono era con su sul sulla da dal dalla per che chi cui non sì si come quando dove perché più ma anche o ed e tra fra circa lo questo questa dietro tratta dice sopra sotto dentro presso vicino",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas é são era foi com sem por para pelo pela que quem não sim se seu sua e ou mas como quando onde pois porque mais muito entre até sobre cerca isso isto esse essa atrás trata diz margem",
    "nl": "de het een en is was zijn waren van voor op aan met uit door over bij naar om te dat die dit deze niet geen wel ja nee er hij zij ze ik wij ook als maar of want omdat wie wat waar wanneer hoe boven achter gaat zo ongeveer oudste tussen",
    "pl": "i w we z ze na do od po za o u nad pod przy dla jest są był była było nie tak to ten ta te tego tej który która które że się jak czy ale lub oraz bo ponieważ przez przed między około jego jej ich co kto gdzie kiedy stary starym najstarsza chodzi tym tekst tekście według mówi odpowiedź",
    "sv": "och är var det en ett den att som på av för med till från inte om har hade eller men när där vid under över ja nej eftersom enligt",
    "ru": "и в во не на что это как по из за от до для его ее она он они мы вы я с со у к о об но а или же был была было были есть нет да так тот та те при над под между после перед потому текст тексте про речь идёт где когда кто",
    "uk": "і й в у не на що це як з із за від до для його її вона він вони ми ви я або але був була було є ні так той та при над під між після перед тому",
}
_VOTES: dict[str, list[tuple[str, float]]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()):
        _VOTES.setdefault(_w, []).append((_lang, 0.0))
_VOTES = {w: [(lang, 1.0 / len(v)) for lang, _ in v] for w, v in _VOTES.items()}

# What an answer that declines says, as word sequences; * stands for up to eight other words, | for a choice.
REFUSALS = """
i|we cannot|can't|couldn't answer|help|assist|say|tell|provide|determine|give|find|comply|respond|share|discuss|confirm|judge|know
i|we can|could not|never answer|help|assist|say|tell|provide|determine|give|find|comply|respond|share|discuss|confirm|judge|know
i|we cannot|can't|couldn't really|reliably|possibly|honestly|truly answer|help|assist|say|tell|provide|determine|give|respond
i am not able|allowed|permitted|willing|prepared|certain|sure
i'm not able|allowed|permitted|willing|prepared|certain|sure
we are not able|allowed|permitted|willing|prepared
i|we am|are unable to
i'm|we're unable to
unable to answer|help|assist|say|tell|provide|determine|give|respond|comply
i|we won't|shan't be able|answer|help|assist|say|tell|provide|give|respond|comply
i|we will|shall not be able|answer|help|assist|say|tell|provide|give|respond|comply
i|i'd|we|we'd would rather|prefer not
i'd|we'd rather|prefer not
i|we prefer not to
i|we|to have|need|want|wish to|must decline|refuse|abstain|pass
i|we must|respectfully|politely decline|refuse|abstain
i|we decline|refuse to
something|nothing i|we have|need|can to|say|tell decline|refuse|you
i|we don't have access|enough|the|any|sufficient|that
i|we do not have access|enough|the|any|sufficient|that
i|we have no access|information|answer|data|idea|way|means
i|we lack the|access|enough|sufficient
i|we don't know the|that|this|what|who|which|where|when|how|enough
i|we do not know the|that|this|what|who|which|where|when|how|enough
outside|beyond what|the|my i|scope|abilities|ability|remit|competence|knowledge can|of|is|here
cannot|can't|couldn't be answered|determined|established|decided|inferred|told|found|derived|concluded|resolved
not be answered|determined|established|decided|inferred|derived|concluded from|here|with|by|on|given|at
not|isn't|no possible|way to answer|say|tell|determine|give|decide|know
impossible to|for answer|say|tell|determine|give|decide|me
not|isn't enough|sufficient information|evidence|context|data|detail|details
no|insufficient|too information|evidence|context|data|little to|is|was|information|evidence|context|given|available
insufficient information|evidence|context|data
passages|passage|evidence|context|text|texts|documents|sources do|does|did not contain|give|state|say|provide|mention|answer|allow|support|include
passages|passage|evidence|context|text|texts|documents|sources don't|doesn't|didn't contain|give|state|say|provide|mention|answer|allow|support|include
no answer|reply can|could|is|was be|possible|available|given|found
no answer|reply can|could be given|found|provided
no conclusion * is possible
must|will remain|stay open|unanswered
remains|stays open|unanswered
unanswerable
annotator could|was not|unable answer|to
as an ai|automated|language * cannot|can't|unable|decline|don't|not|won't
ne permettent|permet|permettant pas de répondre|donner|dire|conclure
je|nous ne peux|puis|saurais|pouvons|parviens pas répondre|aider|dire|donner|déterminer|vous
je|nous ne peux|puis|saurais|pouvons|parviens répondre|aider|dire|donner|déterminer|vous
je ne sais pas
je|nous ne suis|sommes pas en|autorisé|sûr|certain
je|nous ne dispose|disposons pas de|d
je n ai pas assez|accès|de|d|la|les
je n'ai pas assez|accès|de|d|la|les
je|nous suis|sommes désolé|désolée|désolés|navré|incapable
m|m'est|nous|est impossible de|d
est|m'est impossible de répondre|donner|dire|conclure|déterminer
impossible de|d répondre|y|donner|dire|conclure|déterminer
pas|peu assez d|de informations|information|éléments|renseignements|données
pas assez d'informations|d'information|d'éléments|d'indices
je|j préfère|aime|refuse ne|mieux|de pas|ne|répondre
ne puis|peux|peut pas répondre|donner|dire
on ne peut|saurait pas répondre|conclure|dire
aucune réponse ne|n'est|possible|n
kann|können|könnte|konnte ich|wir * nicht beantworten|sagen|helfen|bestimmen|angeben|antworten|ermitteln
ich|wir kann|können|könnte|konnte * nicht beantworten|sagen|helfen|bestimmen|angeben|antworten|ermitteln
ich|wir kann|können|könnte * keine antwort|auskunft|angabe|angaben
kann|können * nicht beantwortet|bestimmt|ermittelt|gesagt|entschieden werden
lässt|lassen sich * nicht beantworten|sagen|bestimmen|ermitteln|feststellen|entscheiden|entnehmen
keine|keinerlei auskunft|antwort geben|möglich|gegeben|darauf
keine antwort darauf|möglich|geben|hierzu|auf
nicht genug|genügend|ausreichend informationen|angaben|hinweise|daten
ich|wir weiß|wissen * nicht
ich|wir bin|sind * nicht in|befugt|sicher|imstande
ich|wir habe|haben keinen|keine|nicht zugriff|zugang|informationen|antwort|angaben|genug
nicht möglich * zu beantworten|sagen|antworten
ich möchte|muss|will * ablehnen
ich möchte|will * nicht antworten|beantworten|sagen
tut mir leid
es|ist ist|mir mir|es leider|nicht nicht|möglich
no puedo|podemos|podría|pude|sé responder|contestar|ayudar|decir|dar|determinar|responderla|contestarla|ayudarte|ayudarle
no me|nos es posible|permitido
me|nos es|resulta imposible
lo siento
no lo|la sé
no es posible responder|contestar|dar|decir|saber|determinar
es imposible responder|contestar|dar|decir|saber|determinar
no se puede responder|contestar|determinar|saber|decir
no estoy|estamos seguro|segura|autorizado|en
no dispongo|tengo|tenemos|cuento|disponemos de|acceso|información|suficiente|respuesta|la|con|datos
los|el pasajes|textos|texto|pasaje|documentos|fragmentos no permiten|contienen|permite|contiene|dicen|indican|mencionan
no hay|existe|tengo suficiente|suficientes|bastante|bastantes información|datos|informaciones|pruebas
prefiero|debo no|declinar|rechazar|abstenerme responder|contestar|la|esta|de|decir
no hay ninguna respuesta
non posso|possiamo|riesco|sono|so rispondere|aiutare|dire|dare|a|in|determinare
mi dispiace
non è possibile rispondere|dire|dare|stabilire
è impossibile rispondere|dire|dare|stabilire
non ci|ho|dispongo sono|abbastanza|informazioni|accesso|di abbastanza|informazioni|sufficienti
não posso|consigo|sei|podemos responder|ajudar|dizer|dar|determinar|a
não é possível responder|dizer|dar|determinar
não há informação|informações|dados suficiente|suficientes
sinto muito
lamento mas|não|informar
ik|we kan|kunnen * niet beantwoorden|zeggen|helpen|antwoorden|geven|bepalen
ik weet * niet
het spijt me
kan niet worden beantwoord|bepaald|vastgesteld
niet genoeg|voldoende informatie|gegevens
geen antwoord mogelijk|geven|op
nie mogę|możemy|potrafię|umiem odpowiedzieć|pomóc|powiedzieć|podać|udzielić
nie można|da odpowiedzieć|ustalić|stwierdzić|powiedzieć|się
nie wiem
nie ma wystarczających|dość informacji|danych
przykro mi
jag kan|vet * inte
tyvärr kan|vet * inte
не могу|можем|смогу|сможем ответить|помочь|сказать|дать|определить
не знаю
к сожалению
невозможно|нельзя ответить|определить|сказать|установить|дать
не имею|располагаю|хватает|достаточно данных|информации|сведений|доступа
недостаточно данных|информации|сведений
не можу|можемо відповісти|допомогти|сказати
на жаль
неможливо відповісти|визначити|сказати
""".strip().splitlines()
# The same in scripts without spaces between words, or with many word forms.
_REFUSAL_CHARS = ("无法回答", "无法回答", "不能回答", "抱歉", "对不起", "无法确定", "没有足够", "我不知道", "拒绝回答", "無法回答", "お答えできません", "わかりません", "不明です", "لا أستطيع", "عذرا", "عذرًا", "لا يمكن الإجابة", "لا يمكنني")

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_LABEL = re.compile(r"^\W*(?:(?:the )?(?:final )?(?:answer|response|question|assistant|reply|result)|antwort|frage|réponse|reponse|question|respuesta|pregunta|resposta|risposta|antwoord|odpowiedź|ответ|вопрос|回答|答案|答|الجواب|q|a|r)\s*(?:\d+)?\s*[:：]\s*", re.I)
_MARKUP = re.compile(r"</?[a-z][^<>]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_END = re.compile(r"[.!?。！？؟]['\"”’»)\]*`]*$")
_INNER_END = re.compile(r"[^\W\d_]{2}[\])\"”’]*[.!?。！？]['\"”’»)]*\s+\S|\d[.!?]\s+[A-ZÀ-ÖØ-Þ]")
#: Words after which no complete answer ends.
_DANGLING = set("the of and to in at by for with from as that which who whose an a is was were are it its his her their because between into than der die das den dem des ein eine einen und von zu zum zur im aus mit nach für dass weil le la les un une des du de et est dans sur par pour avec qui que el los las una unos del al y con por para que porque il lo gli di della een het van op и в на с что по".split())
#: Words that make an answer a sentence, which needs an end.
_VERBS = set("is was are were it has had because names says gives holds been be could would est était sont fut c'est parce car cite donne mène ist war wird wurde sind weil denn lautet ergibt nennt es son fue era porque trata obtiene cita это был была идёт потому is zijn jest è".split()) - {"es"}

_YES_NO = set("yes no ja nein oui non sí si sì não sim nee tak nie да нет".split())


def _compile(pattern: str) -> list:
    return [None if t == "*" else frozenset(t.split("|")) for t in pattern.split()]


class RefusalAutomaton:
    """All refusal patterns as one non-deterministic automaton over words, entered at every word."""

    GAP = 8

    def __init__(self, patterns: list[str]) -> None:
        self.steps = [_compile(p) for p in patterns]
        self.start: dict[str, list[int]] = {}
        for i, p in enumerate(self.steps):
            for w in p[0]:
                self.start.setdefault(w, []).append(i)

    def accepts(self, words: list[str]) -> bool:
        active: list[tuple[int, int, int]] = []  # pattern, next step, words the gap may still skip
        for w in words:
            new = []
            for i, k, gap in active:
                step = self.steps[i]
                if w in step[k]:
                    if k + 1 == len(step):
                        return True
                    new.append((i, k + 2, self.GAP) if step[k + 1] is None else (i, k + 1, 0))
                if gap:
                    new.append((i, k, gap - 1))
            for i in self.start.get(w, ()):
                step = self.steps[i]
                if len(step) == 1:
                    return True
                new.append((i, 2, self.GAP) if step[1] is None else (i, 1, 0))
            active = new
        return False


class SuffixAutomaton:
    """All substrings of a text; coverage() walks another text along it."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, text: str, least: int) -> int:
        """Characters of text that lie in a substring of at least `least` characters of the automaton's text."""
        state = size = done = total = 0
        for i, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size >= least:
                begin = max(done, i - size)
                total += i - begin
                done = i
        return total


def _clean(text: str) -> str:
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _MARKUP.sub(" ", t)


def _unlabel(text: str) -> str:
    while (m := _LABEL.match(text)) and m.end():
        text = text[m.end() :]
    return text


def _flat(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def open_delimiters(text: str) -> bool:
    """True if a bracket or quotation mark opened in text isn't closed, by a stack of delimiters."""
    stack: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    for c in text:
        if c in "([{“«":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
        elif c == '"':
            if stack and stack[-1] == c:
                stack.pop()
            else:
                stack.append(c)
    return bool(stack)


#: Words that names contain, whatever the language around them.
_PARTICLES = frozenset("of de di du da van von der".split())


def language(text: str, learnt: dict[str, str] | None = None) -> dict[str, float]:
    """Votes for each language by function words and script; capitalised words inside (names) and quotations don't vote.

    Where that says little (no language has a whole vote), words whose language was learnt vote as well.
    """
    votes = _votes(text, None)
    return _votes(text, learnt) if learnt and max(votes.values(), default=0.0) < 1.0 else votes


def _votes(text: str, learnt: dict[str, str] | None) -> dict[str, float]:
    text = re.sub(r"[\"“«„][^\"”»“]*[\"”»“]", " ", text)
    votes: dict[str, float] = {}
    first = True
    found = list(_WORD.finditer(text))
    for i, m in enumerate(found):
        w = m.group()
        low = w.lower()
        if low in _PARTICLES and 0 < i < len(found) - 1 and found[i - 1].group()[0].isupper() and found[i + 1].group()[0].isupper():
            continue  # within a name
        parts = re.split(r"['’]", low)
        if re.search(r"['’]\w*[A-ZÀ-ÖØ-Þ]", w) or re.search(r"['’][A-ZÀ-ÖØ-Þ]", text[m.start() : m.end() + 3]):
            first = False
            continue  # a name such as O'Neil
        if first or not w[0].isupper():
            for p in parts:
                own = _VOTES.get(p)
                if own is None and learnt and not w[0].isupper() and p in learnt:
                    own = ((learnt[p], LEARNT_VOTE),)
                for lang, v in own or ():
                    votes[lang] = votes.get(lang, 0.0) + v
            if not w[0].isupper():
                c = ord(w[0])
                if 0x4E00 <= c <= 0x9FFF:
                    votes["zh"] = votes.get("zh", 0.0) + len(w) / 2
                elif 0x3040 <= c <= 0x30FF:
                    votes["ja"] = votes.get("ja", 0.0) + len(w) / 2
                elif 0x600 <= c <= 0x6FF:
                    votes["ar"] = votes.get("ar", 0.0) + 1
                elif 0x400 <= c <= 0x4FF:
                    votes["ru"] = votes.get("ru", 0.0) + 0.5
        first = False
    han = sum(1 for c in text if "一" <= c <= "鿿")
    if han:
        votes["zh"] = votes.get("zh", 0.0) + han / 2
    return votes


def _observed(pairs: Iterable[tuple[str | None, str | None]]) -> Iterator[tuple[str, set[str]]]:
    """(language, lower-case words) of the pairs whose question's function words tell its language clearly."""
    for q, a in pairs:
        votes = sorted(((v, lang) for lang, v in language(_clean(q or "")).items()), reverse=True)
        if not votes or votes[0][0] < 2 or len(votes) > 1 and votes[0][0] < 1.5 * votes[1][0]:
            continue
        yield votes[0][1], {w for t in (q, a) if t for w in _WORD.findall(_clean(t)) if w.islower() and len(w) > 2}


def _main_language(by: dict[str, int], sizes: dict[str, int]) -> str | None:
    """The language a word occurs in almost only, by its pairs and all pairs of each language."""
    rate = {lang: by[lang] / (sizes[lang] + 20) for lang in sorted(by)}
    best = max(rate, key=rate.get)
    return best if by[best] >= 3 and rate[best] >= 0.9 * sum(rate.values()) else None


def learn_words(pairs: list[tuple[str | None, str | None]]) -> dict[str, str]:
    """The language of words that occur in questions and answers of one language almost only.

    A question's language is that of its function words if they are clear; its answer counts as of
    the same language. Rates within each language are compared, so rare languages aren't drowned
    by a few answers in them to questions in a frequent one.
    """
    counts: dict[str, dict[str, int]] = {}
    sizes: dict[str, int] = {}
    for lang, words in _observed(pairs):
        sizes[lang] = sizes.get(lang, 0) + 1
        for w in words:
            by = counts.setdefault(w, {})
            by[lang] = by.get(lang, 0) + 1
    return {w: lang for w, by in counts.items() if (lang := _main_language(by, sizes))}


class _Asked:
    """Stands for the learnt words before they are joined: knows none and notes which are looked up."""

    def __init__(self) -> None:
        self.words: set[str] = set()

    def __contains__(self, word: str) -> bool:
        if len(word) > 2 and word.islower():  # others are never learnt
            self.words.add(word)
        return False


_AUTOMATON = RefusalAutomaton(REFUSALS)


def defect(question: str | None, text: str | None, cut: bool = False, stub: bool = False, learnt: dict[str, str] | None = None) -> str | None:
    """The defect of one pair, or None.

    cut: the last word or name of text goes on wherever it occurs in the record's other texts.
    stub: its last word is the beginning of a known word but none itself. learnt: languages of
    words. Null and blank texts are empty whatever the question; with a null or blank question the
    copy and language tests don't apply.
    """
    if text is None:
        return "empty"
    clean = _clean(text)
    body = _unlabel(clean).strip()
    flat = _flat(body)
    if not flat or flat in ("null", "none", "nan") or _flat(clean) in ("answer", "final answer", "antwort", "réponse", "respuesta", "assistant", "a"):
        return "empty"
    words = flat.split()
    q = _clean(question or "").strip()
    q_flat = _flat(_unlabel(q))
    if q_flat:
        q_words = set(q_flat.split())
        after = _flat(body.rpartition("?")[2].rpartition("？")[2]) if re.search(r"[?？]", body) else ""
        # An answer that shares fewer words or characters than these can't be covered by the automaton as far as a copy is.
        if not after and sum(w in q_words for w in words) >= 0.5 * len(words) and len(flat) >= 0.5 * len(q_flat):
            copied = SuffixAutomaton(q_flat).covered(flat, 5)
            if copied >= 0.8 * len(flat) and copied >= 0.5 * len(q_flat) and sum(w not in q_words for w in words) <= max(3, 0.25 * len(words)):
                return "question_copy"
    if _AUTOMATON.accepts(flat.replace("’", "'").split()) or any(s in clean for s in _REFUSAL_CHARS):
        return "refusal"
    if q_flat:
        q_votes, a_votes = language(q, learnt), language(body, learnt)
        if q_votes and a_votes:
            own = max(q_votes, key=q_votes.get)
            best = max(a_votes, key=a_votes.get)
            enough = 0.9 if max(language(body).values(), default=0.0) >= 0.9 else 1.5  # learnt words weigh less
            if best != own and a_votes[best] >= enough and a_votes[best] > 1.5 * a_votes.get(own, 0.0):
                return "other_language"
    return "truncated" if _breaks_off(body, words, cut, stub) else None


# Words that open an adverbial, after which a sentence goes on behind a comma.
_OPENERS = set("during after before until since between with without while when although because despite from under über während nach vor bis seit zwischen mit ohne obwohl weil nachdem pendant après avant depuis entre avec sans selon lorsque quand durante después antes desde entre con sin según cuando tras dopo prima durante tra fra senza secondo após antes desde entre".split())

_DATED = set("in by since until around im um en em nel vers seit bis".split())


def _sentence(tail: str) -> bool:
    """True if the words can't be names, short phrases or a list of them.

    Signs: an opening adverbial with a sentence after its comma (unless the next item opens alike), a
    year before a clause, a lower-case word alone after names, and an item much longer than a phrase.
    """
    items = [x for x in map(_WORD.findall, re.split(r"[,;\n]", tail)) if x]
    if not items:
        return False
    first = items[0]
    if first[0].lower() in _OPENERS and len(items) > 1 and len(first) > 3 and items[1][0].lower() != first[0].lower():
        return True
    if len(first) > 5 and first[1].isdigit() and first[0].lower() in _DATED:
        return True
    if len(items) > 1 and len(items[-1]) == 1 and items[-1][0].islower() and items[-2][0][0].isupper() and len(items[-2]) > 1:
        return True
    return len(items) > 1 and any(len(x) > 6 and sum(w[0].islower() for w in x) > 3 for x in items)


def _breaks_off(body: str, words: list[str], cut: bool, stub: bool) -> bool:
    tail = body.rstrip("*`_ \t\r\n")
    if re.search(r"(?:\.\.\.|…)$", tail):
        return True
    if _END.search(tail):
        return False
    if re.search(r"[,;:(\[{“«„–—-]$", tail) or open_delimiters(tail):
        return True
    if len(words) == 1 and words[0] in _YES_NO:
        return False
    if cut:
        return True
    found = _WORD.findall(tail)
    last = found[-1] if found else ""
    if last.lower() in _DANGLING and last.islower() and len(words) > 1:
        return True
    if stub and last.islower() and last.isalpha() and tail.endswith(last):
        return True
    if re.match(r"\s*(?:[-*•]|\d+[.)])\s", body):
        return False
    if _INNER_END.search(tail):
        return True
    return len(words) >= 4 and (_sentence(tail) or any(w in _VERBS or w.split("'")[0] in _VERBS for w in words))


def stubs(records: DataFrame) -> DataFrame:
    """(stub) last words of answers that are no known word but the beginning of one.

    Known are all lower-case words of up to 24 letters that occur more than once in the questions
    and in the answers without their last word. Everything is counted over all records.
    """
    t = F.coalesce("text", F.lit(""))
    rest = F.concat(F.expr(f"left(coalesce(text, ''), greatest(0, length(coalesce(text, '')) - {LAST_WORD}))"), F.regexp_replace(F.substring(t, -LAST_WORD, LAST_WORD), r"(?<![\p{L}\p{N}])[\p{L}\p{N}]+$", ""))
    w = F.explode(F.regexp_extract_all(F.concat_ws(" ", "question", rest), F.lit(r"(?<![\p{L}\p{N}])(\p{Ll}{1,24})(?![\p{L}\p{N}])"), F.lit(1)))
    known = materialize(records.select(w.alias("w")).groupBy("w").count().where("count > 1").select("w"), "known_words")
    ends = materialize(records.select(_last_word("text").alias("w")).where("w <> ''").distinct(), "last_words")
    begun = known.select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> left(w, i))")).alias("w")).where("w <> ''").distinct()
    return ends.join(known, "w", "left_anti").join(begun, "w", "left_semi").select(F.col("w").alias("stub"))


def _last_word(text: str):
    return F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), -LAST_WORD, LAST_WORD), r"(?<![\p{L}\p{N}_'’])(\p{Ll}{1,24})[*`_\s]*$", 1)


def learnt_words(records: DataFrame) -> DataFrame:
    """(w, lang) as learn_words gives them for all different pairs of question and text.

    Words are counted where the pairs are and summed by a shuffle; only the numbers of pairs, a row
    for each language, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([lang for _, lang in n], pa.string()), pa.array(n.values(), pa.int64())], names=["w", "lang", "n"])
            n.clear()
            return out

        for b in batches:
            for lang, words in _observed(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                n["", lang] += 1
                n.update((w, lang) for w in words)
                if len(n) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    pairs = records.where("question is not null").select("question", "text").distinct()
    counts = materialize(pairs.mapInArrow(count, "w string, lang string, n long").groupBy("w", "lang").agg(F.sum("n").alias("n")), "word_counts")
    sizes = {r.lang: r.n for r in counts.where("w = ''").collect()}  # a row for each language

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = pa.array([_main_language(dict(x), sizes) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(lang.is_valid()), lang.filter(lang.is_valid())], names=["w", "lang"])

    by = counts.where("w <> ''").groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))  # at most a row for each language
    return by.mapInArrow(decide, "w string, lang string")


def find_defects(records: DataFrame) -> DataFrame:
    """(rec_table, rec_id, defect) of the defective rows of records (rec_table, rec_id, question, text, reference); each row once.

    reference: other texts of the record (evidence, contexts), in which names can be looked up;
    null is allowed in every column but rec_id, and rows with a null rec_id are left out. Tests in
    this order: empty; question_copy (suffix automaton of the question, copied share of the
    answer); refusal (word automaton); other_language (votes of function words and of words whose
    language was learnt from all pairs); truncated (delimiter stack, sentence ends, words and names
    that go on elsewhere; names, short phrases and lists need no end). Records whose function words
    don't tell both languages wait until their words are joined with the learnt ones.
    """
    # No pattern runs over a long text again and again: a last word and a bare name are short.
    end = F.substring(F.coalesce("text", F.lit("")), -LAST_WORD, LAST_WORD)
    token = F.regexp_extract(end, r"(?<![\p{L}\p{M}\p{N}'’-])([\p{L}\p{M}\p{N}'’-]*[\p{L}\p{M}])$", 1)
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.regexp_replace(c, r"\\E", ""), F.lit(r"\E"))
    ref = F.concat_ws("\n", "question", "reference")
    begun = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])"), quoted(token))
    goes_on = F.expr("length(tok) >= 2") & F.call_function("rlike", F.col("ref"), F.concat(F.col("begun"), F.lit(r"\p{L}"))) & ~F.call_function("rlike", F.col("ref"), F.concat(F.col("begun"), F.lit(r"(?![\p{L}\p{M}])")))
    name = F.regexp_extract(F.when(F.length("text") <= LAST_WORD, F.col("text")).otherwise(""), r"^(\p{Lu}[\p{L}\p{M}'’-]*(?: (?:of|\p{Lu}[\p{L}\p{M}'’-]*))*)$", 1)
    name_on = F.expr("length(nm) >= 2") & F.call_function("rlike", F.col("ref"), F.concat(quoted(F.col("nm")), F.lit(r" [\p{Lu}\p{N}(]"))) & ~F.call_function("rlike", F.col("ref"), F.concat(quoted(F.col("nm")), F.lit(r"(?! [\p{Lu}\p{N}(])")))
    rows = records.where("rec_id is not null").select("rec_table", "rec_id", "question", "text", ref.alias("ref"), token.alias("tok"), name.alias("nm"), begun.alias("begun"), _last_word("text").alias("stub"))
    rows = rows.select("rec_table", "rec_id", "question", "text", F.coalesce(goes_on | name_on, F.lit(False)).alias("cut"), "stub")
    rows = rows.join(counted_broadcast(materialize(stubs(records), "stubs").withColumn("found", F.lit(True))), "stub", "left")
    rows = rows.select("rec_table", "rec_id", "question", "text", "cut", F.coalesce("found", F.lit(False)).alias("stub"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, words = [], []
            for q, t, c, s in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                asked = _Asked()
                found.append(defect(q, t, c, s, asked))
                words.append(list(asked.words) or None)
            d, w = pa.array(found, pa.string()), pa.array(words, pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([*b.columns, d, w], names=[*b.schema.names, "defect", "words"])
            yield out.filter(pc.or_(d.is_valid(), w.is_valid()))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [d if m is None else defect(q, t, c, s, dict(m)) for q, t, c, s, d, m in zip(*(b.column(i).to_pylist() for i in range(2, 8)))]
            d = pa.array(found, pa.string())
            keep = d.is_valid()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), d.filter(keep)], names=["rec_table", "rec_id", "defect"])

    schema = "rec_table string, rec_id string, question string, text string, cut boolean, stub boolean, defect string"
    read = materialize(rows.mapInArrow(first, f"{schema}, words array<string>").withColumn("row", F.monotonically_increasing_id()), "read")
    waiting = read.where("words is not null")
    learnt = counted_broadcast(materialize(learnt_words(records), "learnt_words"))
    known = waiting.select("row", F.explode("words").alias("w")).join(learnt, "w").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "lang"))).alias("learnt"))
    waiting = waiting.join(known, "row", "left").select("rec_table", "rec_id", "question", "text", "cut", "stub", "defect", "learnt")
    done = read.where("words is null").select("rec_table", "rec_id", "defect")
    return done.unionByName(waiting.mapInArrow(again, "rec_table string, rec_id string, defect string")).distinct()
