"""Template residue, filler, error pages and script notices instead of content.

A text is taken apart into passages (sentences and lines, without their slots) and slots (bracketed or otherwise marked spans
with the words around them). A naive Bayes model is learned for either from positive and unlabelled examples: what a fixed
list of messages or a slot's marks make all but certain is trusted, a sample of all others is unlabelled, and
expectation-maximization re-weights both until the model settles. Equal examples are one example with a weight, and none is
judged by what its own copies say. The models then score every passage and slot of every text; a record is a case if any of
them is more likely residue than content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Words, chunks, hash_word, mix

#: Records from which trusted and unlabelled passages are taken to fit the model, at most; features of the model; EM rounds.
TRUSTED_RECORDS, UNLABELLED_RECORDS, FEATURES, ROUNDS = 15_000, 4_000, 1 << 21, 12
#: The largest weight of a feature, and of a passage's shape; what each wording of residue that shows it allows; counts that smooth; the prior share of residue among passages and among slots; that of residue
#: among trusted examples; the log odds from which a passage or slot is a case; the label below which an example counts as content; what
#: an unlabelled example keeps of its own copies as evidence for content.
CLIP, SHAPED, WORDING, SMOOTH, PRIOR, SLOT_PRIOR, TRUST, ODDS, FAINT, KEEP = 4.0, 2.0, 1.5, 0.1, 0.01, 0.5, 0.95, 0.0, 0.1, 0.3
#: Unlabelled examples of different wording that make a feature known; steps of the share of unknown features and of the length.
KNOWN, SHARES, LENGTHS = 3, 6, 4
#: Words before and after a slot that are its context.
AROUND = 12

# Starts of messages and fillers that are residue all but certainly.
MESSAGES = r"""
(please )?(enable|activate|turn on|allow) (javascript|java script|scripts|cookies)
(javascript|scripts|scripting) (is|are) (disabled|required|turned off|not enabled|blocked)
(you need to|you must) enable (javascript|scripts|cookies)
this (site|page|app|website) (requires|needs) (javascript|scripts|cookies)
(turn|switch) (them|it) on in (the|your) settings
your browser (does not|doesn't) support
we use cookies
(enable|accept) both to continue
if nothing appears after
loading\.\.\.
(404|page) not found
(the )?(requested )?(page|url|document|article) (you requested |you are looking for )?(could not|cannot|can't|was not|not) (be )?(found|located)
this (article|page|content|record) is no longer available
sorry, the (article|page|document|record)
you will be redirected
return to the home ?page
(error )?(50[0-9]|40[0-9]) ([a-z]+ )?(error|not found|forbidden|unauthorized|bad gateway|bad request|service|internal|gateway|too many)
error (50[0-9]|40[0-9])\s*([-–:.!]|$)
(internal )?server error\s*([:.!]|$)
(an )?unexpected error (has )?occurred
(bad gateway|gateway time-?out|gateway timed out|service (temporarily )?unavailable)
the server is temporarily unable
database connection failed
connection (timed out|refused|reset)
access denied\s*([:.!]|$)
you do not have permission
(too many requests|you have been rate limited|rate limit exceeded)
please verify (that )?you are (a )?human
(complete|completing) the (captcha|challenge)
your session has (expired|timed out)
please (log|sign) in (again )?to continue
(subscribe|register) to read
you have reached your limit
nothing to display
our team has been notified
lorem ipsum
(ut enim ad minim|duis aute irure|excepteur sint|sed do eiusmod|praesent vitae|consectetur adipiscing)
(this is )?(sample|dummy|placeholder|filler) text
it will be replaced by
(your|add your) (content|text|title|subtitle) (goes |text )?here
(click|tap) (here )?to add
replace this (paragraph|text|section)
add (a|your) (short|brief) 
dummy [a-z]+, do not publish
(insert|enter) (your )?(text|title|name|content) here
heading (one|two|three|1|2|3)\.?$
(text ){3,}
(asdf|qwer|test) (asdf|qwer|test)
blindtext
bitte aktivieren sie (javascript|cookies|skripte)
(seite|dokument|artikel) nicht gefunden
der angeforderte (artikel|inhalt)
zugriff verweigert
veuillez activer (javascript|les cookies|les scripts)
(page|article) (introuvable|non trouvée)
accès refusé
por favor, (active|habilite) (los scripts|javascript|las cookies)
(página|pagina) no encontrada
(la )?página solicitada
acceso denegado
(texto|contenido) de (ejemplo|relleno|prueba)
texte (d'exemple|de remplissage)
"""
_MESSAGE = re.compile(r"^[\W_]*(?:error:? )?(?:" + "|".join(x for x in MESSAGES.strip("\n").split("\n")) + ")", re.I)

# Names of control tokens, of markup and of editorial remarks, none of which is a slot.
NOT_SLOTS = set(
    """s pad unk bos eos mask cls sep inst sys endoftext user assistant system
    a abbr article aside b body br button caption cite code col dd del div dl dt em figure footer form h1 h2 h3 h4 h5 h6 head header hr html
    i iframe img input ins label li link main mark meta nav ol option p path pre q script section select small span strong style sub
    summary sup svg table tbody td template textarea tfoot th thead title tr u ul video answer think
    sic edit citation needed emphasis added truncated more cut continued ref refs note notes see and others et al""".split()
)
# Words of navigation lines and names of tags; a passage of such words alone is neither content nor residue.
NAVIGATION = """html body head h1 h2 h3 div span br menu search log in login sign home articles trials contact about back to top skip main content share print cite save
    next previous help news authors figures references download pdf menü suche startseite kontakt inicio buscar accueil recherche""".split()
_NAME = r"[^\W\d_][\w.\- ]{0,40}"
_SLOT = re.compile(
    rf"(?P<double>\{{\{{\s*[\w. |]+\s*\}}\}})|(?P<code><%=?[^%\n]{{1,60}}%>|\{{%[^%\n]{{1,60}}%\}})|(?P<dollar>\$\{{\s*[\w.]+\s*\}})|(?P<printf>%\(\w+\)[sdf])"
    rf"|(?P<at>@@\w+@@)|(?P<percent>%%\w+%%)|(?P<under>(?<!\w)__[A-Za-z][A-Za-z0-9_]*?__(?!\w))|(?P<dollars>\$\$\w+\$\$)|(?P<brace>(?<![\w\\}}^_$])\{{\w+\}})"
    rf"|(?P<angle><(?P<a>{_NAME})>)|(?P<guillemet>«(?P<g>[^\W\d_]{{2,30}})»)|(?P<square>(?<![\w\]])\[(?P<q>{_NAME}(?::[^\]\n]{{1,40}})?)\](?![\w(]))"
    r"|(?P<ref>#(?:REF|NAME|VALUE|N/A|DIV/0|NULL|NUM)[!?]?)|(?P<date>(?<!\w)(?:XX/XX/XX(?:XX)?|XX\.XX\.XX(?:XX)?|XX-XX-XX(?:XX)?|DD/MM/YYYY|MM/DD/YYYY|YYYY-MM-DD|XXXX+)(?!\w))"
)
_MAYBE_SLOT = re.compile(r"[{«$]|@@|<[^\W\d_/|]|<%|\[[^\W\d_]|%[%(]|#[A-Z]|__|XX|YYYY").search
#: Marks that belong to no ordinary text; the other kinds are trusted only with a word that asks to be filled in.
_CERTAIN = {"double", "code", "dollar", "printf", "at", "percent", "under", "dollars", "brace", "ref", "date"}
_FILL = re.compile(r"(?i)\b(insert|your|todo|tbd|fixme|here|placeholder|name|date|title|enter|add|dose|site|author|patient|citation)\b|nachname|vorname|nombre|prénom|datum|fecha")
# Words of sentences that are about slots and forms; the slots they show are not trusted.
_MENTION = re.compile(r"(?i)\b(?:field codes?|merge fields?|place ?holders?|templates?|variables?|syntax|notation|wildcards?|delimiters?|used? as|uses|written as|called|stands? for|asks? [^.]{0,60} to (?:insert|enter|fill))\b")
_NAVIGATION = np.sort(np.array([hash_word(w) for w in NAVIGATION], np.uint64))
_NUMBER, _CODE, _FIRST = (hash_word(f"feature{n}") for n in ("number", "code", "first"))
_SHAPE = np.array([hash_word(f"featureshape{n}") % FEATURES for n in range(SHARES * LENGTHS)], np.int64)
_PLAIN = re.compile(r"[^\W_]+")
#: Where a slot's sentence ends.
_BREAK = re.compile(r"[.!?](?=\s)|\n")
_TAG = re.compile(r"</?[a-z][a-z0-9]{0,9}[^<>]{0,200}>")


def _marks(text: str) -> Iterator[tuple[re.Match, str, str]]:
    """Each slot's match, kind and inner text; control tokens, markup and editorial remarks are none."""
    if not _MAYBE_SLOT(text):
        return
    for m in _SLOT.finditer(text):
        kind, inner = m.lastgroup, m.group(0)
        for group, name in (("a", "angle"), ("g", "guillemet"), ("q", "square")):
            if m.group(group) is not None:
                kind, inner = name, m.group(group)
        words = _PLAIN.findall(inner.lower())
        if kind not in ("angle", "square") or any(w not in NOT_SLOTS for w in words):
            yield m, kind, inner


def bare(text: str) -> str:
    """The text with blanks for its slots, as long as it was."""
    out, at = [], 0
    for m, _, _ in _marks(text):
        out += [text[at : m.start()], " " * (m.end() - m.start())]
        at = m.end()
    return "".join([*out, text[at:]]) if out else text


def slots(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """Features of each slot, and whether it is trusted to be residue."""
    for m, kind, inner in _marks(text):
        before, after = text[max(0, m.start() - 400) : m.start()], text[m.end() : m.end() + 400]
        before, after = _BREAK.split(before)[-1], _BREAK.split(after, maxsplit=1)[0]
        about = bool(_MENTION.search(before) or _MENTION.search(after))
        upper = inner.upper() == inner and len(inner) > 2
        near = [*_PLAIN.findall(bare(before).lower())[-AROUND:], *_PLAIN.findall(bare(after).lower())[:AROUND]]
        names = [f"slot{kind}", f"slot{kind}{'upper' if upper else 'lower'}", *(f"slotword{w}" for w in _PLAIN.findall(inner.lower())), *(f"slotnear{w}" for w in near), *(["slotmention"] * about)]
        hashed = np.unique(np.array([hash_word(n) for n in names], np.uint64) % np.uint64(FEATURES)).astype(np.int64)
        yield hashed, not about and (kind in _CERTAIN or upper or bool(_FILL.search(inner)))


def _stops(points: np.ndarray) -> np.ndarray:
    """Where passages end: at line ends, and at . ! ? or an ideographic full stop before white space or a tag."""
    at = np.flatnonzero((points == 46) | (points == 10) | (points == 33) | (points == 63) | (points == 0x3002))
    after = points[np.minimum(at + 1, len(points) - 1)]
    return at[(points[at] == 10) | (after == 32) | (after == 10) | (after == 60) | (at == len(points) - 1)]


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage and feature, sorted by passage, and the passage's text for each passage number."""
    points = words.points
    if not len(words.hash):
        none = np.zeros(0, np.int64)
        return none, none, none
    stop = _stops(points)
    passage = np.searchsorted(stop, words.start)
    other = np.searchsorted(_NAVIGATION, words.hash)
    other = _NAVIGATION[np.minimum(other, len(_NAVIGATION) - 1)] != words.hash
    digit = np.concatenate([[0], np.cumsum((points >= 48) & (points <= 57), dtype=np.int32)])
    n_digits, size = digit[words.end] - digit[words.start], words.end - words.start
    h = np.where(n_digits > 0, np.uint64(_NUMBER), words.hash)
    code = (n_digits == 3) & (size == 3) & np.isin(points[words.start], [52, 53])
    h = np.where(code, np.uint64(_CODE), h)
    first = np.concatenate([[True], passage[1:] != passage[:-1]])
    with np.errstate(over="ignore"):
        two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    joined = passage[1:] == passage[:-1]
    p = np.concatenate([passage, passage[1:][joined], passage[first]])
    f = np.concatenate([h, two[joined], mix(h[first] ^ np.uint64(_FIRST))])
    doc = np.full(int(passage[-1]) + 1, -1)
    doc[passage] = words.doc
    content = np.bincount(passage, weights=other)[p] > 0
    p, f = p[content], f[content]
    return p, (f % np.uint64(FEATURES)).astype(np.int64), doc


def _spans(words: Words, passages: np.ndarray, wanted: np.ndarray) -> list[tuple[int, str]]:
    """The text of the wanted passages."""
    points = words.points
    stop = _stops(points)
    begin, end = np.concatenate([[0], stop + 1]), np.append(stop, len(points))
    return [(int(p), words.text[begin[p] : end[p] + 1].strip()) for p in wanted]


def _examples(unlabelled: float):
    """kind (0 passage, 1 trusted passage, 2 slot, 3 trusted slot) and features of the trusted examples of all the batch's records and of the unlabelled ones of a share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, draw = batch.column("text").to_pylist(), batch.column("u").to_numpy()
            kinds: list[int] = []
            content: list[bytes] = []
            for t, u in zip(texts, draw.tolist(), strict=True):
                for values, sure in slots(t):
                    if sure or u < unlabelled:
                        kinds.append(2 + sure)
                        content.append(values.astype(np.int32).tobytes())
            for words in chunks([bare(t).lower() for t in texts]):
                p, f, doc = features(words)
                order = np.lexsort((f, p))
                p, f = p[order], f[order].astype(np.int32)
                start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
                end = np.append(start[1:], len(p))
                for (q, span), a, b in zip(_spans(words, p, p[start]), start.tolist(), end.tolist(), strict=True):
                    sure = bool(_MESSAGE.match(_TAG.sub(" ", span)))
                    if sure or draw[words.first + doc[q]] < unlabelled:
                        kinds.append(int(sure))
                        content.append(f[a:b].tobytes())
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "f": pa.array(content, pa.binary())})

    return run


@dataclass
class Model:
    """Log odds of each feature for residue against content, and which features of passages are known."""

    weight: np.ndarray
    known: np.ndarray


def _shape(unknown: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The feature of a passage's share of unknown features and of its length."""
    return _SHAPE[np.minimum(unknown * SHARES // np.maximum(size, 1), SHARES - 1).astype(np.int64) * LENGTHS + np.minimum(size // 6, LENGTHS - 1)]


def learn(trusted: list[bytes], unlabelled: list[bytes], prior: float, known: np.ndarray | None = None) -> np.ndarray:
    """Log odds of each feature for residue against content, by EM; examples are the bytes of their features.

    A feature that residue never showed counts against it only as far as its absence is surprising. In the expectation step
    an unlabelled example and its copies are left out of the counts it is judged by, but for a part of one that counts as content.
    """
    if not trusted:
        return np.zeros(FEATURES, np.float32)
    groups: dict[tuple[bool, bytes], int] = {}
    for sure, examples in ((True, trusted), (False, unlabelled)):
        for x in examples:
            groups[sure, x] = groups.get((sure, x), 0) + 1
    sure, copies = np.array([k[0] for k in groups]), np.array([*groups.values()], np.float64)
    sizes = np.array([len(k[1]) // 4 for k in groups])
    f, example = np.frombuffer(b"".join(k[1] for k in groups), np.int32).astype(np.int64), np.repeat(np.arange(len(groups)), sizes)
    if known is not None:
        shape = _shape(np.bincount(example, weights=~known[f], minlength=len(sizes)), sizes)
        f, example = np.concatenate([f, shape]), np.concatenate([example, np.arange(len(sizes))])

    def most(label: np.ndarray) -> np.ndarray:
        """The largest weight of a feature, by the number of residue's wordings that show it."""
        return WORDING * np.bincount(f, weights=label[example], minlength=FEATURES)

    def counted(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        own_yes, own_no = (copies * label)[example], (copies * (1 - label))[example]
        yes, no = (np.bincount(f, weights=x, minlength=FEATURES) for x in (own_yes, own_no))
        own_yes, own_no = np.where(sure[example], 0.0, own_yes), np.where(sure[example], 0.0, np.maximum(own_no - KEEP, 0.0))
        return yes, no, own_yes, own_no, max((copies * (1 - label)).sum(), 1.0) / max((copies * label).sum(), 1.0)

    def odds(yes: np.ndarray, no: np.ndarray, ratio: float, most: np.ndarray) -> np.ndarray:
        return np.where(yes + no > 1e-6, np.clip(np.log((yes + SMOOTH) / (no + SMOOTH * ratio) * ratio), -CLIP, most), 0.0)

    limit = np.full(FEATURES, CLIP)
    limit[_SHAPE] = SHAPED
    label = sure.astype(np.float64)
    before = np.log(np.where(sure, TRUST / (1 - TRUST), prior / (1 - prior)))
    for _ in range(ROUNDS):
        yes, no, own_yes, own_no, ratio = counted(label)
        own = np.where(sure[example], 0.0, WORDING * label[example])
        others = odds(np.maximum(yes[f] - own_yes, 0.0), np.maximum(no[f] - own_no, 0.0), ratio, np.minimum(np.maximum(most(label)[f] - own, 0.0), limit[f]))
        new = 1 / (1 + np.exp(-np.clip(before + np.bincount(example, weights=others, minlength=len(sizes)), -30, 30)))
        new[new < FAINT] = 0.0
        settled, label = np.abs(new - label).max() < 1e-3, new
        if settled:
            break
    yes, no, _, _, ratio = counted(label)
    return odds(yes, no, ratio, np.minimum(most(label), limit)).astype(np.float32)


def model(kinds: list[int], examples: list[bytes]) -> Model:
    """The models of passages and of slots, whose features do not meet, from examples as _examples gives them."""
    of = [[x for k, x in zip(kinds, examples, strict=True) if k == kind] for kind in range(4)]
    seen = np.zeros(FEATURES, np.int32)
    for x in set(of[0]):
        seen[np.unique(np.frombuffer(x, np.int32))] += 1
    known = seen >= KNOWN
    passages, marks = learn(of[1], of[0], PRIOR, known), learn(of[3], of[2], SLOT_PRIOR)
    return Model(passages + marks, known)


def fit(df: DataFrame, id_col: str, text_col: str) -> Model:
    """The model, from bounded samples of records."""
    total = max(1, df.count())
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(8)), F.lit(1_000_000)) / 1_000_000
    share = min(1.0, TRUSTED_RECORDS / total)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), u.alias("u")).where(F.col("u") < share)
    got = rows.mapInArrow(_examples(UNLABELLED_RECORDS / total), "kind int, f binary").toArrow()
    return model(got.column("kind").to_pylist(), got.column("f").to_pylist())


def score(words: Words, texts: list[str], fitted: Model) -> np.ndarray:
    """Log odds of the most residue-like passage or slot of each text; words: of the bare texts; texts: as they were."""
    prior, weight = np.log(PRIOR / (1 - PRIOR)), fitted.weight
    out = np.full(words.docs, prior)
    p, f, doc = features(words)
    if len(p):
        odds, size, unknown = np.bincount(p, weights=weight[f], minlength=len(doc)), np.bincount(p, minlength=len(doc)), np.bincount(p, weights=~fitted.known[f], minlength=len(doc))
        odds += prior + weight[_shape(unknown, size)]
        real = (doc >= 0) & (size > 0)
        np.maximum.at(out, doc[real], odds[real])
    for i, t in enumerate(texts):
        for values, _ in slots(t):
            out[i] = max(out[i], np.log(SLOT_PRIOR / (1 - SLOT_PRIOR)) + weight[values].sum())
    return out


def residue(df: DataFrame, id_col: str, text_col: str, fitted: Model | None = None) -> DataFrame:
    """id and odds of the records that hold residue where content should be; odds: log odds of their worst passage.

    Null, empty and very short texts without residue are no cases; repeated rows come out repeatedly. Other columns are
    not read. fitted: a model from fit(); learned from df itself if not given.
    """
    shared = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col) if fitted is None else fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for words in chunks([bare(t).lower() for t in texts]):
                odds = score(words, texts[words.first : words.first + words.docs], fitted)
                hit = np.flatnonzero(odds > ODDS)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(words.first + hit)), pa.array(odds[hit])], names=["id", "odds"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, odds double").withColumnRenamed("id", id_col)
