"""Template residue, filler, error pages and script notices: positive-unlabelled naive Bayes over passages."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About how many different records the classifier is fitted on, and among how many trusted ones are looked for (chosen by the hash of their text).
FIT_UNLABELLED, FIT_POOL = 5000, 30_000
#: Longest text that is drawn for the fit, and longest trusted one; everything is scored, whatever its length.
FIT_CHARS, TRUSTED_CHARS = 20_000, 600
#: Pseudo-observations of the background distribution in each class.
SMOOTHING = 30.0

# Typical texts of the kinds looked for; they count as trusted records beside those found by pattern.
SEEDS = """
404 Not Found
403 Forbidden
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
503 Service Temporarily Unavailable
504 Gateway Timeout
408 Request Timeout
429 Too Many Requests
400 Bad Request
401 Unauthorized
410 Gone
The page you requested could not be found.
The page you are looking for does not exist.
Sorry, the page could not be loaded.
This page is not available right now.
Page not found
Oops! Something went wrong on our end.
Access denied. You don't have permission to access this resource.
Your request was blocked.
Too many requests. Please slow down and try again later.
Please try again later.
Service is down for maintenance and will be back shortly.
Your session has expired. Please sign in again.
This content is not available in your region.
This content is restricted to registered users.
Database connection failed.
Connection reset by peer
Connection timed out
Fatal error: Uncaught exception
Checking your browser before you proceed...
The requested resource could not be loaded.
The page took too long to respond.
An unexpected error occurred. If the problem persists, contact the administrator.
Back to home
Seite nicht gefunden
Die angeforderte Seite wurde nicht gefunden.
Interner Serverfehler
Page introuvable
Erreur du serveur
Página no encontrada
Error del servidor. Inténtelo de nuevo más tarde.
Please enable JavaScript to view this page.
You need to enable JavaScript to run this app.
JavaScript is disabled in your browser.
JavaScript is required to use this site.
This site requires scripts to work properly.
Your browser does not support JavaScript.
Turn on scripting and reload the page to continue.
Your browser blocks scripts and cookies.
Bitte aktivieren Sie JavaScript, um fortzufahren.
Veuillez activer JavaScript pour afficher cette page.
Active JavaScript en su navegador para ver este contenido.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Sample text goes here.
Your text here.
Insert text here.
This is placeholder text and will be replaced.
Placeholder copy
dummy text dummy text dummy text dummy text
sample sample sample sample sample
Content coming soon.
Text to follow.
To be written.
TBD TBD TBD
TODO TODO
xxx xxx xxx
asdf asdf qwer asdf
Test test test
Add a description here.
Write your first sentence here.
Hier steht ein Blindtext.
Blindtext folgt.
Texte provisoire à remplacer.
Texto de relleno.
""".strip().splitlines()

_ID = r"[A-Za-z][A-Za-z0-9]*(?:[_. ][A-Za-z0-9]+){0,3}"
# Syntaxes of template slots.
SLOT_KINDS = {
    "double": rf"\{{\{{\s*{_ID}\s*\}}\}}", "block": rf"\{{%-?\s*{_ID}\s*-?%\}}", "dollar_brace": rf"\$\{{\s*{_ID}\s*\}}", "hash_brace": rf"#\{{\s*{_ID}\s*\}}", "erb": rf"<%=?\s*{_ID}\s*%>",
    "percent_s": rf"%\(\s*{_ID}\s*\)[sd]", "at": rf"@@\s*{_ID}\s*@@", "under": r"(?<![\w])__[A-Za-z][A-Za-z0-9_]*__(?![\w])", "dollar": r"\$[A-Z][A-Z0-9_]*\$", "percent": r"%[A-Z][A-Z0-9_]*%",
    "guillemet": rf"<<\s*{_ID}\s*>>", "wiki": rf"\[\[\s*{_ID}\s*\]\]", "angle": r"<(?:INSERT |YOUR |ENTER |ADD )?[A-Z][A-Z0-9]*(?:[_. ][A-Z0-9]+){0,3}>",
    "square": r"\[(?:INSERT |YOUR |ENTER |ADD |Insert |Your |insert |your )?[A-Z][A-Z0-9]*(?:[_. ][A-Z0-9]+){0,3}\]|\[(?:[Ii]nsert|[Yy]our|[Ee]nter) [A-Za-z ]{2,30}\]", "brace": r"(?<![\w\\$#{}^_])\{(?:\d|[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+){0,3})\}(?!\})",
}
_SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SLOT_KINDS.items()))
_SLOT_SIGN = re.compile(r"[{<\[$%@_]")  # every slot holds one of them
#: Words by which a text may speak about a slot instead of holding it: one pseudo-observation each; the fit learns their weights and those of all other words.
CUES = frozenset("written writes write wrote typed word slot slots placeholder placeholders variable variables syntax template templates means denotes notation quoted spelled literal literally string sic".split())

# Trusted records: short texts with one of these messages, or texts that are little more than slots.
_TRUSTED = re.compile(
    r"(?i)\b(?:40[0134]|410|429|50[0234])\b[ \-:–]*(?:not found|forbidden|bad (?:request|gateway)|unauthorized|service|internal|gateway|too many)|page (?:could not be found|not found|introuvable)|internal server error|(?:enable|activate|activer|aktivieren sie|active) javascript|javascript is (?:disabled|required)"
    r"|lorem ipsum|adipiscing elit|consectetur|sample text goes here|placeholder (?:copy|text)|dummy (?:text|copy)|access denied\. |session has expired|too many requests|gateway timeout|service (?:temporarily )?unavailable|fatal error: |seite nicht gefunden|content coming soon"
)
_SPLIT = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\r\n]+|\s\|\s")
_TOKEN = re.compile(r"⟦\w+⟧|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[{}<>\[\]$%@#_\\=]")


_LOWER = bytes(range(97, 123))


def passages(text: str) -> list[str]:
    """Sentences and lines of a text, none of them blank; an upper-case text is lowered first."""
    raw = text.encode("utf-8", "replace")
    if 5 * (len(raw) - len(raw.translate(None, _LOWER))) < len(raw):  # else upper-case letters can't be four fifths
        letters = [c for c in text if c.isalpha()]
        if letters and sum(c.isupper() for c in letters) > 0.8 * len(letters) and not _SLOT.search(text):
            text = text.lower()
    return [p for p in (x.strip() for x in _SPLIT.split(text)) if p]


def loops(words: list[str]) -> bool:
    """True if the same one to three words come again and again, four times or more, and nothing else."""
    n = len(words)
    return len(set(words)) <= 3 and any(n >= 4 * k and words[:-k] == words[k:] for k in (1, 2, 3))


def features(passage: str, lexicon: frozenset[str] = frozenset()) -> tuple[list[str], int]:
    """Features of a passage, and how many slots it holds.

    Words (digits as 0, capitalised words that aren't in the lexicon as one name token) and pairs of them; passages with
    slots are described by their slot kinds and by the words within three of a slot instead,
    because a slot may stand in any sentence. Passages that only repeat a few words have a feature for it.
    """
    slots = [m.lastgroup for m in _SLOT.finditer(passage)] if _SLOT_SIGN.search(passage) else []
    rest = _SLOT.sub(" ⟦slot⟧ ", passage) if slots else passage
    toks = []
    for t in _TOKEN.findall(rest):
        if t[0].isdigit():
            if toks and toks[-1] == "0":
                continue
            t = "0"
        elif t[0].isupper():
            low = t.lower()
            t = low if low in lexicon else "⟦name⟧"
        toks.append(t)
    if slots:
        near: set[str] = set()
        for i, t in enumerate(toks):
            if t == "⟦slot⟧":
                near.update(toks[max(0, i - 3) : i + 3])
        near -= {"⟦slot⟧", "⟦name⟧", "0"}
        return [f"slot:{k}" for k in sorted(set(slots))] + [f"near:{t}" for t in sorted(near) if t[0].isalpha()], len(slots)
    if loops(toks):
        return ["⟦loop⟧"] * 3 + sorted(set(toks)), 0
    return toks + [f"{a} {b}" for a, b in zip(["⟦start⟧", *toks], [*toks, "⟦end⟧"])], 0


def trusted(text: str) -> bool:
    """True for records that are surely residue: a short known message, or text of which slots are a large part."""
    slots = _SLOT.findall(text)
    if len(slots) >= 2 and (len(slots) * 40 > len(text)):
        return True
    return len(text) <= TRUSTED_CHARS // 2 and _TRUSTED.search(text) is not None


class _Names(dict):
    """The feature of each token as written (see features), kept for the next time."""

    def __init__(self, lexicon: frozenset[str]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, t: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[t] = f = "0" if t[0].isdigit() else t if not t[0].isupper() else low if (low := t.lower()) in self.lexicon else "⟦name⟧"
        return f


class ResidueModel:
    """Naive Bayes weights of features (log odds of residue), learnt from trusted and unlabelled passages.

    prior is that of passages without slots, slot_prior that of passages with slots (unfilled
    against spoken about); words beside a slot that the fit hasn't seen count 0.
    """

    def __init__(self, weights: dict[str, float], prior: float, lexicon: frozenset[str], slot_prior: float = 3.0) -> None:
        self.weights, self.prior, self.lexicon, self.slot_prior = weights, prior, lexicon, slot_prior
        self.token = _Names(lexicon).__getitem__
        self.pairs = {tuple(f.split(" ")): w for f, w in weights.items() if " " in f}

    def score(self, passage: str) -> float:
        """Log odds that a passage is residue; fewer than two words without a slot never are."""
        fs, slots = features(passage, self.lexicon)
        if not slots and sum(f[0].isalpha() or f[0] == "⟦" for f in fs if " " not in f) < 2:
            return -1e3
        w = self.weights
        return (self.slot_prior if slots else self.prior) + sum(w.get(f, 0.0) for f in fs)

    def residue(self, text: str | None) -> bool:
        """The decision for a record: every passage is scored, and one is enough."""
        return bool(text) and any(self._quick(p) > 0 and self.score(p) > 0 for p in passages(text))

    def _quick(self, passage: str) -> float:
        """The score (but for rounding, upwards) without lists of features; 1 if slots, loops or few words need score()."""
        if _SLOT_SIGN.search(passage):
            return 1.0
        toks = list(map(self.token, _TOKEN.findall(passage)))
        if "0" in toks:
            toks = [t for i, t in enumerate(toks) if t != "0" or not i or toks[i - 1] != "0"]
        if len(set(toks)) < 4:
            return 1.0
        return self.prior + 1e-9 + sum(filter(None, map(self.weights.get, toks))) + sum(filter(None, map(self.pairs.get, zip(["⟦start⟧", *toks], [*toks, "⟦end⟧"]))))


def _slot_weights(rows: list[tuple[tuple[str, ...], float, float]], background: Counter, rounds: int = 12) -> tuple[dict[str, float], float]:
    """(weights, prior) of passages with slots: unfilled (positive) or spoken about, by expectation-maximization.

    rows: features, count among trusted, count among unlabelled passages. A slot that wasn't filled
    may stand anywhere, so words beside one are drawn from the background (all words of passages
    without slots) or from what stands beside the trusted ones; what stands beside slots far more
    often than that is speech about them. That class begins with a pseudo-observation of each cue
    word and of the rest of the vocabulary; its words are then learnt.
    """
    words = sum(background.values()) + 1.0
    vocab = {f for fs, _, _ in rows for f in fs} | {f"near:{c}" for c in CUES} | {f"slot:{k}" for k in SLOT_KINDS}
    ids = {f: i for i, f in enumerate(sorted(vocab))}
    near = np.array([f.startswith("near:") for f in sorted(vocab)], bool)
    base = np.array([(background.get(f[5:], 0) + 0.5) / (words + 0.5 * near.sum()) if f.startswith("near:") else 1 / len(SLOT_KINDS) for f in sorted(vocab)])
    cue = np.array([float(f.startswith("near:") and f[5:] in CUES) for f in sorted(vocab)])
    r = np.array([i for i, (fs, _, _) in enumerate(rows) for _ in fs], np.int64)
    c = np.array([ids[f] for fs, _, _ in rows for f in fs], np.int64)
    known, free = (np.array([x[k] for x in rows], float) for k in (1, 2))
    lift = np.zeros(len(ids))
    open_n = np.bincount(c, (known + free)[r], len(ids)) if len(rows) else np.zeros(len(ids))
    surely = np.maximum(open_n - 1 - 2 * np.sqrt(open_n), 1e-9)  # what isn't chance
    lift[near] = np.log(surely[near] / (open_n[near].sum() + 1) / base[near])
    trusted_n = np.bincount(c, known[r], len(ids)) if len(rows) else np.zeros(len(ids))
    cue *= np.log((open_n + 1) / (open_n[near].sum() + 1) / base) > 1  # a cue word that is as usual elsewhere is none
    spoken = np.where(near, cue + (lift > 3) * (trusted_n == 0), 0.0)  # begins where words crowd beside slots
    share = np.where(np.bincount(r, spoken[c], len(rows)) >= 1.0, 0.2, 0.95) if len(rows) else np.zeros(0)
    weights, prior = np.zeros(len(ids)), 3.0
    for _ in range(rounds):
        pos, neg = known + free * share, free * (1 - share)
        a = np.bincount(c, pos[r], len(ids)) if len(rows) else np.zeros(len(ids))
        b = np.bincount(c, neg[r], len(ids)) if len(rows) else np.zeros(len(ids))
        for group in (near, ~near):
            heavy = a[group].sum() + 50.0  # the background counts as much as what was seen
            p = (a[group] + heavy * base[group]) / (a[group].sum() + heavy)
            pseudo = cue[group] + 25.0 * base[group] if group is near else 5.0 * base[group]
            q = (b[group] + pseudo) / (b[group].sum() + pseudo.sum())
            weights[group] = np.log(p) - np.log(q)
        rate = (pos.sum() + 19.0) / (pos.sum() + neg.sum() + 20.0)
        prior = math.log(rate / (1 - rate))
        if len(rows):
            share = 1 / (1 + np.exp(-np.clip(prior + np.bincount(r, weights[c], len(rows)), -30, 30)))
    return {f: float(weights[i]) for f, i in ids.items()}, prior


def fit(unlabelled: list[str], known: list[str], rounds: int = 6, known_weight: float = 1.0, slotted: list[str] = ()) -> ResidueModel:
    """Fits the model by expectation-maximization.

    known records begin as residue, unlabelled ones as clean; each round re-estimates every
    unlabelled passage's share of residue and the passages of known records, seeds stay residue.
    Passages are counted once for each different feature list. known_weight: how many records of
    the collection a known one stands for, against 1 of an unlabelled one; the prior uses it, so
    that it doesn't depend on how many of each were drawn. slotted: further unlabelled records, of
    which only the passages with slots are used.
    """
    small = Counter(w for t in (*known, *unlabelled) for w in set(_TOKEN.findall(t)) if w[0].islower())
    lexicon = frozenset(w for w, n in small.items() if n > 1) | frozenset(w.lower() for t in SEEDS for w in _TOKEN.findall(t))
    seen: dict[tuple, list[float]] = {}
    slots: dict[tuple, list[float]] = {}
    background: Counter = Counter()
    for texts, kind in ((SEEDS, 0), (known, 1), (unlabelled, 2), (slotted, 3)):
        for t in texts:
            sure = kind == 1 and (not _SLOT.search(t) or _TRUSTED.search(t))
            for p in passages(t):
                fs, n = features(p, lexicon)
                if n:
                    slots.setdefault(tuple(fs), [0.0, 0.0])[kind >= 2] += 1
                if n or kind == 3:
                    continue
                seen.setdefault(tuple(fs), [0.0, 0.0, 0.0])[2 if kind == 1 and not sure else kind] += 1  # lines beside slots prove nothing
                if kind == 2:
                    background.update(f for f in fs if " " not in f and f[0].isalpha())
    ids: dict[str, int] = {}
    keys = list(seen)
    rows, cols = [], []
    for i, fs in enumerate(keys):
        for f in fs:
            rows.append(i)
            cols.append(ids.setdefault(f, len(ids)))
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    counts = np.array([seen[k] for k in keys]).reshape(-1, 3)
    total = counts.sum(1)
    share = np.where(counts[:, 0] > 0, 1.0, counts[:, 1] / total * 0.9)
    true = counts @ np.array([0.0, known_weight, 1.0])  # of the collection
    size = len(ids)
    log_odds, prior = np.zeros(size), 0.0
    for _ in range(rounds):
        a = np.bincount(cols, (share * total)[rows], size)
        b = np.bincount(cols, ((1 - share) * total)[rows], size)
        back = SMOOTHING * (a + b + 0.01) / (a.sum() + b.sum() + 0.01 * max(size, 1))  # a feature that one class lacks speaks against it
        log_odds = np.log((a + back) / (a.sum() + SMOOTHING)) - np.log((b + back) / (b.sum() + SMOOTHING))
        rate = float(np.clip((share * true).sum() / max(true.sum(), 1.0), 1e-3, 0.2))
        prior = math.log(rate / (1 - rate))
        s = np.bincount(rows, log_odds[cols], len(keys))
        post = 1 / (1 + np.exp(-np.clip(prior + s, -30, 30)))
        share = np.where(counts[:, 0] > 0, 1.0, post)
    weights = {f: float(log_odds[i]) for f, i in ids.items() if abs(log_odds[i]) > 0.3}
    of_slots, slot_prior = _slot_weights([(k, a, b) for k, (a, b) in slots.items()], background)
    return ResidueModel(weights | of_slots, prior, lexicon, slot_prior)


def train(documents: DataFrame, text: str = "text") -> ResidueModel:
    """A model fitted on a sample of about FIT_UNLABELLED different texts, and the trusted ones among about FIT_POOL.

    Texts are drawn by the hash of the text against a threshold that follows from the number of
    rows, before anything is shuffled or sent, so what reaches the driver doesn't grow. Everything
    is then scored; only the fit is on a sample.
    """
    n = max(documents.count(), 1)
    some_p, pool_p = min(1.0, FIT_UNLABELLED / n), min(1.0, FIT_POOL / n)
    place = F.expr("xxhash64(t) / 18446744073709551616D + 0.5D")  # in [0, 1)
    t = documents.select(F.col(text).alias("t")).where(f"t is not null and length(t) between 1 and {FIT_CHARS}").withColumn("place", place)
    hint = F.col("t").rlike(r"\{[{%]? ?[A-Za-z]|<%|%\(|@@|__|<<|[\[<$%][A-Z]|\[\[|(?i)javascript|lorem|consectetur|not found|forbidden|gateway|placeholder|dummy|unavailable|server error|denied|expired|too many|fatal error|introuvable|gefunden|coming soon|sample text") & (F.length("t") <= TRUSTED_CHARS)
    pool = t.where(F.col("place") < pool_p).select("t", (F.col("place") < some_p).alias("drawn"), hint.alias("hint")).where("drawn or hint").distinct().collect()  # about FIT_UNLABELLED texts and the likely ones of the pool
    rows = sorted(tuple(r) for r in pool)
    sure = [x for x, _, hinted in rows if hinted and trusted(x)]
    own = set(sure)
    return fit([x for x, drawn, _ in rows if drawn and x not in own], sure, known_weight=some_p / pool_p, slotted=[x for x, drawn, hinted in rows if hinted and not drawn and x not in own])


def flag(documents: DataFrame, key: str = "doc_id", text: str = "text", model: ResidueModel | None = None) -> DataFrame:
    """(key, residue boolean) of every row: whether a passage holds an unfilled placeholder, filler, an error message or a script notice.

    Null, empty and blank texts aren't residue; texts of any length are read whole. One narrow
    pass after the fit, no shuffle. A passage of fewer than two words and without a slot is clean.
    """
    model = model or train(documents, text)
    weights, prior, lexicon, slot_prior = model.weights, model.prior, model.lexicon, model.slot_prior
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ResidueModel(weights, prior, lexicon, slot_prior)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.residue(t) for t in b.column(1).to_pylist()], pa.bool_())], names=["k", "residue"])

    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, residue boolean").withColumnRenamed("k", key)
