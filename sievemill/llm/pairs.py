"""Defective question and answer pairs, each with the name of its one defect.

empty_answer: nothing is said. copied_question: the answer's shingles are contained in the question and the longest common
subsequence covers both but for a frame. refusal: a refusal template aligns with the answer and nothing else is said.
other_language: the answer is mostly in another language than the question. truncated_answer: the answer stops before its
end (module truncated).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import truncated

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: Words around a question that still are a frame; share of the question a copy must hold and of the copy the question must hold.
FRAME, COPIED = 12, 0.8
#: Characters of an answer that are looked at first: what has too many foreign words there is no copy.
HEAD = 160
#: Share of a template's words that must align, in order.
ALIGNED = 0.99

# Words of prompt frames, which belong to no question.
PROMPT_FRAME = re.compile(r"#+\s*(?:instruction|input|response|question|answer|system|user|assistant)\s*:?|<\|[^|<>]{1,30}\|>|\[/?INST\]|</?s>|^\s*(?:user|human|question|q|instruction|prompt)\s*:|\b(?:assistant|answer|response)\s*:\s*$", re.I | re.M)

# Refusal templates. Words must align in order, close to each other; | parts alternatives.
TEMPLATES = """
i|we can|could|will|may|must|shall not help|answer|assist|provide|respond|comment|discuss|give|offer|advise|say|share|do|engage|fulfil|fulfill|comply|generate|interpret|speak|diagnose|recommend|tell|talk|write|support
i|we am|are not able|going|allowed|permitted|authorized|authorised|qualified|comfortable|prepared|willing|equipped|supposed|free to|in|with
i|we am|are unable|unwilling to
i|we will not be able to
i|we am|are not in a position to
i do not think|feel|believe i should|can|could
i|we do not have|possess enough|sufficient|the|any information|context|data|knowledge|details to|about|on
i|we have been instructed|told|asked|trained|programmed not to
i|we have|need|must|want to|respectfully|politely decline|refuse|abstain|refrain|pass
i|we must|will|would respectfully|politely|have decline|refuse|abstain|refrain|pass|to
i must|will|shall pass on
i|we have to leave unanswered
i|we will leave unanswered
i|we would rather|prefer not
i|we decline|refuse to
sorry i|but can|am|will not|unable
sorry this|that|your topic|question|request|subject is outside|beyond|not
guidelines|policy|policies|instructions|rules|programming do|does not allow|permit|let
guidelines|policy|policies|instructions|rules|programming prevent|prevents|prohibit|prohibits|forbid|forbids me|us|this|that
is|was not something i|we am|can|are|could|may
no answer|reply|response|comment|advice can|will|may be given|provided|made|offered
no reply|answer|response|comment on will|can
requests|request|questions|question|this|that can|will|could not be fulfilled|answered|met|completed|processed|discussed
assistant|model|system|bot does|do|can|will|is not respond|answer|reply|discuss|provide|able
would|is not be|appropriate appropriate|for for|me|us
would|is be|inappropriate inappropriate|for for|me|us
is|falls|lies|fall outside|beyond what|my|the|our i|scope|remit|area|we|expertise
are|is blocked|prohibited|forbidden|restricted by policy|guidelines|rules
as a|an ai|language|virtual assistant|model i am|can|do|will not
as a|an ai i am|can|do|will not
no|não puedo|posso|podemos ayudar|responder|proporcionar|contestar|comentar|ajudar|comentar
lo siento pero no
je ne peux|puis|suis pas
ich kann|darf|möchte dazu|darauf|ihnen|das|hierzu|diese|leider keine|nicht
leider kann|darf ich
non posso rispondere|aiutare|fornire|commentare
"""
_SHORT = [(re.compile(p), r) for p, r in ((r"\bcan't\b|\bcannot\b", "can not"), (r"\bwon't\b", "will not"), (r"n't\b", " not"), (r"'m\b", " am"), (r"'re\b", " are"), (r"'d\b", " would"), (r"'ve\b", " have"), (r"'ll\b", " will"))]


def _plain(text: str) -> list[str]:
    """Lower-cased words, with short forms written out."""
    text = text.lower()
    for pattern, full in _SHORT:
        text = pattern.sub(full, text)
    return _WORD.findall(text)


_TEMPLATES = [[set(p.split("|")) for p in line.split()] for line in TEMPLATES.strip().split("\n")]
# What may stand beside a refusal without being an answer.
ASIDE = re.compile(
    r"^(?:(?:i am|i'm|we are)? ?(?:very |so )?(?:sorry|afraid)|thank(?:s| you)\b|apolog|unfortunately|regrettably|hmm|please (?:speak|talk|consult|contact|refer|see|ask|seek|reach|try|note|check)|(?:you (?:should|could|may|might)|try|consult|contact|ask|seek|see|speak) "
    r"|is there anything|can i help|let me know|feel free|if you have|a qualified|your (?:question|request|message|care team|doctor)|i understand|i appreciate|that is|that's|this is|still\b|however\b|as an? |good question|great question|for (?:safety|legal|medical|privacy)|instead\b|requests? )", re.I
)
SENTENCE = re.compile(r"[^.!?;。]+[.!?;。]*")

# Frequent small words by language, and the scripts that name a language by themselves.
FUNCTION_WORDS = {
    "en": "the of and in to a is was that for with as by on are were from at be this which or an had it not have after but than their before has who what how when why does do would should can could may about between into during without you your my they we there its his her these most only such more if next within any all also no yes will explain describe list compare tell give true false outline summarise summarize name state define discuss",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn wer was wie warum welche welcher ich wir unter bevor nahm meist durch gegen während etwa innerhalb",
    "fr": "le la les de des du et en un une est que qui dans pour pas sur plus par au aux avec ce il sont se ne ou mais comme été être cette son ses leur ont nous vous je elle à a d l s chez après avant selon environ malgré vers lors autour chaque quel quelle quels comment pourquoi où puis souvent afin sans sous",
    "es": "el la los las de del y en un una que es por con para no se lo al como más su sus o pero ha fue son entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante según tras qué cómo cuál cuándo antes cada este esta unos les ser al",
    "it": "il lo la i gli le di del della dei delle da dal in nel nella un una che è e per con non si su al alla come più ma sono ha anche dopo prima ogni questo questa tra fra chi cosa quando perché quale secondo sotto se nei dalla dal ai sono stati nonostante intorno fino",
    "pt": "o a os as de do da dos das e em no na nos nas um uma que é por com para não se ao à como mais foi são mas seu sua entre quando muito sem até também pelo pela ou já após antes cada segundo foram durante apesar quem qual quais porque sobre depois dizem",
    "nl": "de het een en van in op te dat die is voor met zijn niet aan er om ook als bij door naar uit nog maar werd worden heeft hebben was over tot per na wie wat hoe waarom welke wanneer aldus volgens tegen tijdens ondanks meer minder dan deze dit waren werden kan",
    "sv": "och i att det som en på är av för med till den har de inte om ett var men sig från vid när kan efter under hur vad vilka eller så",
    "da": "og i at det som en på er af for med til den har de ikke om et var men sig fra ved når kan efter under hvordan hvad eller så",
    "no": "og i å det som en på er av for med til den har de ikke om et var men seg fra ved når kan etter under hvordan hva eller så",
    "pl": "w i na z się nie do to że o jak za od po przez jest dla przy są co po ale oraz czy był była który która które lub ma u",
    "tr": "ve bir bu da de için ile olarak olan daha çok gibi sonra kadar göre en ne mi her ya",
    "ro": "și în de la cu pe un o este nu se din că pentru mai ale ai a au sau după fost prin sunt cei cele",
    "cs": "a v na se je že o s z do i ve k pro za by po od jako který která které nebo při byl byla jsou",
    "fi": "ja on ei se että oli hän mutta kun ovat joka tai niin kuin myös vain noin jälkeen ennen mukaan",
    "hu": "a az és hogy nem is egy van meg de ez azt mint csak ha már volt vagy szerint után",
    "id": "yang dan di dari untuk dengan pada ini itu tidak dalam adalah akan oleh sebagai atau telah juga setelah",
}
_MARKS = ".,;:!?¿¡()[]\"'«»“”‘’-–—*#"
_BY_WORD: dict[str, list[str]] = {}
for _language, _list in FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _BY_WORD.setdefault(_w, []).append(_language)
SCRIPTS = [
    ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯ᄀ-ᇿ]")), ("zh", re.compile(r"[一-鿿㐀-䶿]")), ("cyrillic", re.compile(r"[Ѐ-ӿ]")), ("arabic", re.compile(r"[؀-ۿ]")),
    ("hebrew", re.compile(r"[֐-׿]")), ("greek", re.compile(r"[Ͱ-Ͽἀ-῿]")), ("devanagari", re.compile(r"[ऀ-ॿ]")), ("thai", re.compile(r"[฀-๿]")), ("bengali", re.compile(r"[ঀ-৿]")), ("tamil", re.compile(r"[஀-௿]")),
]
_FOREIGN = re.compile("|".join(p.pattern for _, p in SCRIPTS))


@lru_cache(maxsize=1 << 16)
def _languages(token: str) -> tuple[tuple[str, float], ...]:
    """The languages that have the token as a small word, each with its part of it."""
    names = _BY_WORD.get(token) or _BY_WORD.get(token.strip(_MARKS), ())
    return tuple((name, 1 / len(names)) for name in names)


def language(text: str, sure: bool = False) -> str:
    """A language code or script, or '' if the text tells none; sure: only on several different small words."""
    if not text.isascii():
        found = _FOREIGN.findall(text)
        letters = sum(map(str.isalpha, text))
        if len(found) * 3 > letters:
            counts = {name: len(p.findall(text)) for name, p in SCRIPTS}
            if counts["ja"] * 10 > counts["zh"]:
                counts["ja"] += counts["zh"]
            return max(counts, key=counts.get)
    score: dict[str, float] = {}
    kinds: dict[str, int] = {}
    tokens = text.lower().replace("'", " ").replace("’", " ").split()
    n = len(tokens)
    for w, times in Counter(tokens).items():
        for name, part in _languages(w):
            score[name] = score.get(name, 0.0) + times * part
            kinds[name] = kinds.get(name, 0) + 1
    if not score:
        return ""
    best = max(score, key=score.get)
    second = max((v for k, v in score.items() if k != best), default=0.0)
    if sure and (kinds[best] < 2 or kinds[best] + score[best] < max(4.0, 0.16 * n)):
        return ""
    return best if score[best] >= max(1.0, 0.06 * n, 1.2 * second) else ""


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def is_copy(question: Sequence[str], answer: str) -> bool:
    """Whether a lower-cased answer is nothing but the question's words, once or repeated, in a frame of a few words."""
    k = min(3, len(question))
    if not k:
        return False
    asked, around = _runs(tuple(question), k)
    head = answer[:HEAD]
    if len(answer) > HEAD and _outside(_WORD.findall(head[: head.rfind(" ") + 1]), around, k) > FRAME + k:  # its first words tell most answers apart
        return False
    said = _WORD.findall(PROMPT_FRAME.sub(" ", answer))
    if _outside(said, around, k) > FRAME + k or len(said) < COPIED * len(question):
        return False
    if sum(r in asked for r in zip(*(said[i:] for i in range(k)), strict=False)) < COPIED * len(asked):
        return False
    times = max(1, round(len(said) / len(question)))  # the question may be repeated
    common = sum(_lcs(question, said[i * len(said) // times : (i + 1) * len(said) // times]) for i in range(times)) if times > 1 else _lcs(question, said)
    return common >= COPIED * len(question) * times and len(said) - common <= FRAME


def _outside(said: list[str], around: frozenset, k: int) -> int:
    return sum(r not in around for r in zip(*(said[i:] for i in range(k)), strict=False))


@lru_cache(maxsize=4096)
def _runs(words: tuple[str, ...], k: int) -> tuple[frozenset, frozenset]:
    """The question's runs of k words, and these with the ones where it begins anew."""
    return tuple(frozenset(zip(*(w[i:] for i in range(k)), strict=False)) for w in (words, (*words, *words[: k - 1])))


def _aligns(template: list[set[str]], words: list[str]) -> bool:
    """The template's words in order, each at most three words between it and the one before."""
    for start in (i for i, w in enumerate(words) if w in template[0]):
        at, done = start, 1
        while done < len(template):
            step = next((j for j in range(at + 1, min(at + 5, len(words))) if words[j] in template[done]), None)
            if step is None:
                break
            at, done = step, done + 1
        if done >= ALIGNED * len(template):
            return True
    return False


# One of these stands in any sentence that a template aligns with.
_CUES = "not|n't|unable|sorry|declin|refus|outside|beyond|blocked|prohibit|prevent|abstain|refrain|pass|unanswered|no answer|no reply|no response|no comment|rather|inappropriate|forbid|restricted|puedo|siento|peux|puis|désolé|kann|leider|darf|posso".split("|")


def is_refusal(answer: str) -> bool:
    """Whether the answer declines and says nothing else."""
    refused = False
    for m in SENTENCE.finditer(answer.replace("’", "'")):  # most answers say something in their first sentence
        part = m.group(0)
        low = part.lower()
        if any(c in low for c in _CUES):
            own = _plain(part)
            if any(_aligns(t, own) for t in _TEMPLATES) and not _reports(own):
                refused = True
                continue
            n = len(own)
        else:
            n = len(_WORD.findall(low))
        if n > 4 and not ASIDE.match(part.strip(" \n\t\"'-*>#")):
            return False
    return refused


# Words for the speaker, the reader and the request; a sentence without any of them reports what others did.
_SPEAKERS = set("i we me us my our you your this that here request requests question questions topic assistant model bot system policy policies guidelines instructions rules programming answer reply response comment advice sorry ich wir je nous yo lo no não non leider dazu darauf".split())


def _reports(words: list[str]) -> bool:
    """A sentence about what others could not do."""
    return _SPEAKERS.isdisjoint(words)


@lru_cache(maxsize=4096)
def _asked(question: str) -> tuple[str, tuple[str, ...], str]:
    """A question without its prompt's frame, its words and its language; prompts repeat."""
    bare = PROMPT_FRAME.sub(" ", question)
    return bare, tuple(_WORD.findall(bare.lower())), language(bare)


def defect(question: str | None, answer: str | None) -> str:
    """The defect that the pair shows by itself, or ''; cut answers are told apart afterwards."""
    if truncated.is_blank(answer):
        return "empty_answer"
    bare, words, asked_in = _asked(question or "")
    low = answer.lower()
    if is_copy(words, low):
        return "copied_question"
    if is_refusal(answer):
        return "refusal"
    if asked_in:
        said_in = language(answer, sure=True)
        if said_in and said_in != asked_in:
            return "other_language"
    return ""


def _defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [defect(q, a) for q, a in zip(batch.column("question").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("table_name"), batch.column("row_id"), pa.array(got), batch.column("text")], names=["table_name", "row_id", "defect", "text"])


def defects(pairs: DataFrame) -> DataFrame:
    """table_name, row_id and defect of each defective pair of (table_name, row_id, question, text).

    A null question has no words and no language: its pair can only be empty, a refusal or cut. Repeated rows come out once.
    """
    own = pairs.select("table_name", F.col("row_id").cast("long").alias("row_id"), F.col("question").cast("string").alias("question"), F.col("text").cast("string").alias("text"))
    seen = own.mapInArrow(_defects, "table_name string, row_id long, defect string, text string")
    judged = truncated.judge(seen, corpus=own, source=["table_name"])
    name = F.when(F.col("defect") != "", F.col("defect")).when(F.col("cut"), F.lit("truncated_answer"))
    return judged.select("table_name", "row_id", name.alias("defect")).where(F.col("defect").isNotNull()).dropDuplicates(["table_name", "row_id"])
