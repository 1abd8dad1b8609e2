"""Broken prompt and response pairs: a reply's clauses tagged by a conditional random field.

A reply is cut into clauses. Each is described by its words, how it ends, how much of it stands in the question, and
how well the question's language explains it. A linear-chain conditional random field tags every clause as working
towards an answer, answer, refusal, echo, foreign or unfinished; the coverage of the clauses by tags decides the
pair's defect.

The field is trained here. Its labels don't come from rules on these features but from known edits of a bounded
sample of the replies, most of which are sound: a sound reply ends with its answer; cut off before that, its last
clause is unfinished; a question in front of it, or instead of it, is an echo; with the question of another pair in
another language, or with its letters exchanged, it is foreign; declining sentences are refusals. The field then tags
the sample itself and learns once more with the replies it is sure of, which brings in the words of real refusals and
answers.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.clauses import CLOSE, COLON, LETTER, N_CLASSES, OPEN, PAIR, STOP, WIDE_STOP, Clauses, mix
from quillmill.llm.crf import Crf, Sequences
from quillmill.llm.encode import chunks
from quillmill.llm.languages import Languages

LABELS = ("step", "answer", "refusal", "echo", "foreign", "unfinished")
STEP, ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(6)
SAMPLE_ROWS = 3000  #: most replies that the models are trained on
VOCABULARY = 12_000  #: most words and word pairs that have weights
COVER = 0.85  #: share of a reply that must be echo

# Frequent words from which the languages of the sample are learned.
LANGUAGE_WORDS = {
    "en": "the a of and to is in that for so as at it with by be not this but which because was on if has had are from or only each an there were i into first would does what gives its we they he she you can may also more than then when who both between after before about",
    "de": "der die das und ist nicht ein eine einen einer wir zu den dem mit für auf auch sich von im bei nach hat es gibt dass um zuerst weil wurde bleibt am durch damit sofort an",
    "fr": "le la les et est un une des du que qui nous dans il y a aussi par ce ces pas pour sur avec au à d ne se donne jours après de plus n on coûte environ égale",
    "es": "el la los las y es un una que en con de no hay por para se del entre eso queda también como ha su al sigue siendo después días unos cuesta la primero suponemos las antes muy pero",
    "it": "il lo la le gli e è un una che con di non per così si del della anche come dopo giorni prima alle al rimane otteniamo supponiamo quindi poiché cambiata",
    "pt": "o a os as e é um uma que com de não para por se do da também como depois dias em ao isso fica",
    "nl": "de het een en is niet van met voor op ook dat die wij te in na dagen eerst door omdat",
    "pl": "i w na nie się z do jest to że po dni przez jak więc najpierw ma",
    "sv": "och är det en ett inte som på med för av till att den har efter dagar vi om",
    "tr": "ve bir bu da de ile için sonra gün göre olarak önce çok",
}
# Declining sentences that the field is shown; it meets others in the sample and in use.
OPENERS = ("", "", "I'm sorry, but ", "I am sorry, however ", "Sorry, ", "Unfortunately, ", "I apologise, but ", "Thank you for the question, but ", "As a language assistant, ", "I must be upfront: ", "No. ", "Thought 1: ")
DECLINES = (
    "I can't help with that request", "I cannot assist with this", "I'm unable to answer this question", "I won't provide an answer here", "my guidelines don't allow me to work this out",
    "this is something I'm not permitted to do", "I'm not comfortable giving a result here", "I have to decline", "I must refuse to answer", "it goes beyond what I may comment on",
    "I would rather not attempt this", "answering would go against the rules I was given, so I'll stop here", "I do not feel able to share such an assessment", "I must pass on this one; no result from my side",
    "I have been asked to leave such questions to a clinician, and I will", "a request like this one would not be answered by me", "this is not something I can take part in", "I can only talk about other topics, please look elsewhere",
    "it wouldn't be right for me to give an answer", "I will not be giving a solution", "our policy rules this out", "the policy I work under rules this out", "that is a matter I do not discuss", "I prefer not to respond to this", "please ask someone else, I cannot be responsible for a result",
)
AFTER = ("", "", " I hope you understand.", " Please consult a qualified professional.", " Let me know if you have a different topic.", " Thanks for understanding!", " I would rather point you to an official source.", " You may wish to ask an expert.", " Is there something else you would like to discuss?", " I can only talk about other subjects.", " Thank you for understanding.", " Perhaps a colleague can say more.", "\nAction 1: Finish[declined]", "\nAction 1: Finish[not permitted]", "\nAction 1: Finish[unable to help]")
ELSEWHERE = (
    "Es tut mir leid, aber dabei kann ich nicht helfen.", "Das darf ich leider nicht beantworten.", "Ich bin nicht befugt, das zu bearbeiten.",
    "Je suis désolé, mais je ne peux pas vous aider avec cela.", "Je ne suis pas autorisé à répondre à cette question.", "Je ne peux malheureusement pas traiter cette demande.",
    "Lo siento, pero no puedo ayudar con eso.", "No me está permitido responder a esta pregunta.", "Lamentablemente no puedo atender esta petición.",
    "Mi dispiace, ma non posso aiutare con questa richiesta.", "Desculpe, mas não posso ajudar com isso.", "К сожалению, я не могу помочь с этим вопросом.", "抱歉，我无法回答这个问题。",
)
ECHO_LABELS = ("", "", "", "Question: ", "Q: ", "The question is: ", "Problem: ", "User: ", "> ", "Prompt: ", "**Question:** ")
ECHO_TAILS = ("", "", "", "", "\nA:", "\nAnswer:", "\n\nSolution:", " Let's think step by step.")
REPLY_LEADS = ("Sure! ", "Certainly. ", "Okay, ", "Here we go: ")
LABEL_WORDS = (
    "answer|final answer|the answer is|the final answer is|the answer|response|reply|output|result|solution|final result|the final result is|in short|hence|therefore|so|"
    "antwort|die antwort lautet|die antwort ist|ergebnis|lösung|réponse|la réponse est|résultat|solución|respuesta|la respuesta es|resultado|risposta|ответ|答案|a|q|thought|action|observation|finish|boxed|text|final|none|null"
)
_BARE = re.compile(rf"(?:{LABEL_WORDS})(?:\s+\d+)?", re.I)
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|\\boxed|```\w*")
_INKS = re.compile(r"[^\W_]+")
_LABEL_TOKENS = frozenset(w for part in LABEL_WORDS.split("|") for w in part.split())


def is_empty(reply: str | None) -> bool:
    """Nothing but white space, invisible characters, punctuation, markup, or a bare label or wrapper."""
    if reply is None:
        return True
    t = _MARKUP.sub(" ", reply)
    words = " ".join(_INKS.findall(t))
    if not words:
        return True
    if not _BARE.fullmatch(words):
        return False
    return not re.search(r"\w+\W*[:=]\s*\w", t) and _label_only(t, words)


def _label_only(text: str, words: str) -> bool:
    # a single bare letter or word is a value unless it comes with a label's punctuation
    return len(words) > 1 and bool(re.search(r"[:*<>\[\]{}]", text)) or words.lower() in ("answer", "final answer", "response", "antwort", "respuesta")


def _onehot(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(values), n), dtype=np.float32)
    out[np.arange(len(values)), values] = 1
    return out


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _bins(values: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return _onehot(np.searchsorted(np.array(edges), values, "right"), len(edges) + 1)


EVIDENCE = (-20.0, -8.0, -3.0, 0.0, 3.0, 8.0, 20.0, 40.0)
SHARES = (0.001, 0.2, 0.4, 0.6, 0.75, 0.9)


class Described:
    """Clauses of a batch of pairs, with the features of each."""

    def __init__(self, replies: list[str], questions: list[str | None], languages: Languages) -> None:
        self.clauses = c = Clauses(replies)
        asked = list(dict.fromkeys(questions))
        number = {q: i for i, q in enumerate(asked)}
        qid = np.array([number[q] for q in questions], dtype=np.int64) if questions else np.empty(0, np.int64)
        q = Clauses([a or "" for a in asked])
        has = np.bincount(q.token_row, minlength=len(asked)) > 0 if len(asked) else np.empty(0, bool)
        self.asked = has[qid] if len(qid) else np.empty(0, bool)
        salt = lambda ids: mix((ids.astype(np.uint64) + np.uint64(1)) * PAIR)
        known = np.unique(q.exact ^ salt(q.token_row))
        q_next = np.flatnonzero(q.token_row[1:] == q.token_row[:-1]) if len(q.start) > 1 else np.empty(0, np.int64)
        known_pairs = np.unique(mix(q.exact[q_next] * PAIR + q.exact[q_next + 1]) ^ salt(q.token_row[q_next]))
        token_q = qid[c.token_row] if len(c.token_row) else np.empty(0, np.int64)
        own = c.mean(_among(c.exact ^ salt(token_q), known))
        exact2, word2, at = c.pairs()
        met = np.bincount(c.clause[at], _among(exact2 ^ salt(token_q[at]), known_pairs), minlength=c.n)
        n2 = np.bincount(c.clause[at], minlength=c.n)
        share = np.where(n2 > 0, met / np.maximum(n2, 1), own)
        # languages: how much better another language, or the floor, explains the clause than the question's own
        _, _, q_rows = languages.scores(q)
        k = len(languages.names)
        lang, level = languages.spoken(q_rows)
        self.language = lang[qid] if len(qid) else np.empty(0, np.int64)
        level = level[qid] if len(qid) else np.empty(0)
        per, letters, rows = languages.scores(c)
        per[:, k] *= level[c.row]
        rows[:, k] *= level
        self.evidence, self.row_evidence = self._evidence(per, self.language[c.row], k), self._evidence(rows, self.language, k)
        told = self.language[c.row] >= 0
        self.told = told & (letters >= 12)
        self.weight = c.size.astype(np.float64)
        kind, end, core = c.kind, c.ink[np.maximum(c.close - 1, 0)], c.core[np.maximum(c.close - 1, 0)]
        end_kind, core_kind = np.where(end >= c.begin, kind[end], 14), np.where(core >= c.begin, kind[core], 14)
        depth = np.concatenate(([0], np.cumsum((kind == OPEN).astype(np.int64) - (kind == CLOSE))))
        balance = depth[c.close] - depth[c.begin] if c.n else np.empty(0)
        fence = np.cumsum((c.raw == 96).astype(np.int64))
        odd = ((fence[c.row_end] - np.concatenate(([0], fence[c.row_end[:-1]]))) // 3) % 2 == 1 if c.n_rows else np.empty(0, bool)
        last, first = c.is_last, c.is_first
        before = np.concatenate(([False], (core_kind == 7)[:-1])) & ~first if c.n else first
        digits = c.mean(c.digit)
        head = kind[c.begin] == LETTER
        upper = head & (c.raw[c.begin] != c.low[c.begin])
        lower_end = (core_kind == LETTER) & last
        f = lambda *x: np.stack([np.asarray(v, dtype=np.float32) for v in x], axis=1)
        final = c.first + c.size - 1  # the last token
        capital = c.raw[c.start[final]] != c.low[c.start[final]] if c.n else first
        number = c.digit[final] if c.n else first
        open_code = odd[c.row] if c.n else first
        letters_end = np.where(c.digit[final], 0, c.stop[final] - c.start[final]) if c.n else np.zeros(0, np.int64)
        colon = np.maximum.accumulate(np.where(kind == COLON, np.arange(len(kind)), -1))
        at_colon = colon[np.maximum(c.close - 1, 0)]
        after = np.where(at_colon >= c.begin, final - np.searchsorted(c.start, at_colon) + 1, 30) if c.n else np.zeros(0, np.int64)  # tokens after the last colon
        size = _bins(c.size, (2, 3, 5, 8, 13, 25))
        ev = np.where(told, self.evidence, 0.0)
        rev = np.where(told, self.row_evidence[c.row], 0.0)
        self.x = np.concatenate(
            [
                f(np.ones(c.n), last, first, last & first, before, before & last, upper, ~upper & head, odd[c.row] & last if c.n else last, (balance > 0) & last, (balance > 0), lower_end, told, own, share),
                _onehot(np.minimum(end_kind, N_CLASSES - 1), N_CLASSES) * last[:, None],
                _onehot(np.minimum(core_kind, N_CLASSES - 1), N_CLASSES) * last[:, None],
                f(np.isin(core_kind, (STOP, WIDE_STOP)) & ~last, core_kind == COLON, capital & last, ~capital & (letters_end > 0) & last, *(v & (c.size <= 3) & w for v in (capital, ~capital & ~number, number) for w in (last & ~open_code, last & first, before & last & ~open_code))),
                _bins(letters_end, (1, 2, 4)) * last[:, None],
                _bins(after, (1, 2, 5, 30)), _bins(after, (1, 2, 5, 30)) * last[:, None],
                size, size * last[:, None],
                _bins(digits, (0.001, 0.3, 0.6, 0.999)),
                _bins(own, SHARES), _bins(share, SHARES), _bins(share, SHARES) * last[:, None],
                _bins(ev, EVIDENCE) * told[:, None], _bins(rev, EVIDENCE) * told[:, None],
            ],
            axis=1,
        ) if c.n else np.zeros((0, self.width()), dtype=np.float32)
        self.share = share
        # words and pairs of words, in the order of their clauses
        owner = np.concatenate([c.clause, c.clause[at]])
        h = np.concatenate([c.word, word2])
        # a word with the build of the next token, which may be a name that no vocabulary has
        build = np.where(c.digit, 1, np.where(c.raw[c.start] != c.low[c.start], 2, 3)).astype(np.uint64) if len(c.start) else np.empty(0, np.uint64)
        owner, h = np.concatenate([owner, c.clause[at]]), np.concatenate([h, mix(c.word[at] * np.uint64(0xA0761D6478BD642F) + build[at + 1])])
        edge = mix(c.word[c.first] ^ np.uint64(0x5DEECE66D)) if c.n else np.empty(0, np.uint64)
        owner, h = np.concatenate([owner, np.arange(c.n)]), np.concatenate([h, edge])
        order = np.argsort(owner, kind="stable")
        self.owner, self.hashes = owner[order], h[order]

    @staticmethod
    def width() -> int:
        """Number of dense features."""
        return 15 + 2 * N_CLASSES + 4 + 9 + 4 + 2 * 5 + 2 * 7 + 5 + 3 * (len(SHARES) + 1) + 2 * (len(EVIDENCE) + 1)

    @staticmethod
    def _evidence(scores: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
        if not k or not len(scores):
            return np.zeros(len(scores))
        own = scores[np.arange(len(scores)), np.maximum(lang, 0)]
        others = scores.copy()
        others[np.arange(len(scores)), np.maximum(lang, 0)] = -np.inf
        return np.where(lang >= 0, others.max(1) - own, 0.0)

    def sequences(self, vocabulary: np.ndarray) -> Sequences:
        """The clauses for the field, words by their place in the sorted vocabulary."""
        at = np.minimum(np.searchsorted(vocabulary, self.hashes), max(len(vocabulary) - 1, 0))
        good = vocabulary[at] == self.hashes if len(vocabulary) else np.zeros(len(self.hashes), dtype=bool)
        return Sequences(self.x, self.clauses.per_row, at[good], self.owner[good])


class Tagger:
    """The trained models: languages, vocabulary and field."""

    def __init__(self, languages: Languages, vocabulary: np.ndarray, field: Crf) -> None:
        self.languages, self.vocabulary, self.field = languages, vocabulary, field

    def tags(self, d: Described) -> np.ndarray:
        """The label of every clause."""
        return self.field.decode(d.sequences(self.vocabulary))

    def defects(self, replies: list[str], questions: list[str | None]) -> list[str | None]:
        """The defect of each pair, or none."""
        out: list[str | None] = []
        for first, part in chunks(replies, 500_000):
            d = Described(part, questions[first : first + len(part)], self.languages)
            found = decide(d, self.tags(d))
            c = d.clauses
            other = np.bincount(c.token_row, ~self._labels(c), minlength=c.n_rows)
            for i in np.flatnonzero(other == 0):  # every word is one of a label's: the pair may hold nothing
                if is_empty(part[i]):
                    found[i] = "empty"
            for i in np.flatnonzero(np.array(["<" in t or "```" in t or "\\boxed" in t for t in part])):
                if not found[i] == "empty" and is_empty(part[i]):
                    found[i] = "empty"
            out += found
        return out

    def _labels(self, c: Clauses) -> np.ndarray:
        known = np.unique(Clauses([" ".join(sorted(_LABEL_TOKENS))]).exact)
        return _among(c.exact, known) | c.digit


def decide(d: Described, tags: np.ndarray) -> list[str | None]:
    """The defects that the coverage of the clauses by tags amounts to; a row without words has none yet."""
    c = d.clauses
    n = c.n_rows
    cover = np.stack([np.bincount(c.row, d.weight * (tags == k), minlength=n) for k in range(len(LABELS))], axis=1)
    total = cover.sum(1)
    last = np.full(n, STEP)
    last[c.row[c.is_last]] = tags[c.is_last]
    stated = cover[:, ANSWER] > 0
    told = np.bincount(c.row, d.weight * d.told * np.isin(tags, (STEP, ANSWER, FOREIGN)), minlength=n)
    foreign = np.bincount(c.row, d.weight * d.told * (tags == FOREIGN), minlength=n)
    out: list[str | None] = [None] * n
    for i in np.flatnonzero((total > 0) & (~stated & ((last == UNFINISHED) | (cover[:, REFUSAL] > 0) | (cover[:, ECHO] >= COVER * total)) | (foreign > 0))):
        if not stated[i] and cover[i, REFUSAL] > 0 and last[i] != UNFINISHED:
            out[i] = "refusal"
        elif not stated[i] and last[i] == UNFINISHED:
            out[i] = "truncated"
        elif not stated[i] and d.asked[i] and cover[i, ECHO] >= COVER * total[i]:
            out[i] = "copied_question"
        elif d.asked[i] and foreign[i] >= 0.5 * told[i] and foreign[i] > 0:
            out[i] = "other_language"
    return out


Parts = list[tuple[str, int]]


def _cut_off(reply: str, rng: random.Random) -> str | None:
    """A sound reply cut inside a clause, before its last token at the latest."""
    tokens = [m.end() for m in re.finditer(r"\w+", reply)]
    if len(tokens) < 5:  # a reply of a word or two is a value, an option or a name
        return None
    code = reply.find("```")
    kind = rng.random()
    if kind < 0.2:  # only the value is missing
        at = re.sub(r"\W*[\w.,_'-]*\W*$", "", reply) if rng.random() < 0.3 else reply[: tokens[-1]].rstrip("0123456789.,_'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-")
        return at if 0 < len(at) < len(reply) and re.search(r"\w", at) else None
    if kind < 0.35:  # after a sign that wants more
        signs = [m.end() for m in re.finditer(r"[(\[{=+*/,;:-]", reply[: tokens[-2]]) if m.end() > tokens[2]]
        if signs:
            return reply[: rng.choice(signs)]
    if code >= 0 and kind < 0.7 and code + 4 < tokens[-2]:
        at = rng.randrange(code + 4, tokens[-2])
    else:
        at = rng.randrange(tokens[2], tokens[-2])
    t = reply[:at].rstrip()
    return t if not re.search(r"[.!?…。？！][\s\"”’)*_`\]]*$", t) and re.search(r"\w", t) else None


def _echo(question: str, rng: random.Random) -> str:
    """The question, as it is or slightly changed."""
    q = question.strip()
    kind = rng.randrange(9)
    if kind == 0:
        q = re.sub(r"[^\w\s]", "", q)
    elif kind == 1:
        q = q.lower() if rng.random() < 0.5 else q.upper()
    elif kind == 2:
        q = q + rng.choice(("\n", " ", "\n\n")) + q
    elif kind == 3:
        q = f"\"{q}\"" if rng.random() < 0.5 else f"“{q}”"
    elif kind == 4:
        q = "\n".join("- " + s for s in re.split(r"(?<=[.!?])\s+", q))
    elif kind == 5:
        words = q.split()
        for _ in range(-(-(len(words) - 1) // 25)):
            del words[rng.randrange(len(words))]
        q = " ".join(words)
    return rng.choice(ECHO_LABELS) + q


def _refusal(rng: random.Random, names: list[str]) -> str:
    if rng.random() < 0.25:
        return rng.choice(ELSEWHERE)
    core = rng.choice(DECLINES)
    if names and rng.random() < 0.2:
        core += ", " + rng.choice(names)
    opener = rng.choice(OPENERS)
    core = core if opener.endswith((", ", "but ", "however ")) and opener else core[0].upper() + core[1:]
    text = opener + core + "." + rng.choice(AFTER)
    text = text.replace("'", "’") if rng.random() < 0.2 else text
    return text.lower() if rng.random() < 0.15 else text


def _cipher(text: str, rng: random.Random) -> str:
    """The text with its letters exchanged: words of no known language."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = "".join(rng.sample(letters, len(letters)))
    return text.translate(str.maketrans(letters + letters.upper(), mixed + mixed.upper()))


def edited(pairs: list[tuple[str, str | None]], begins: list[list[int]], sound: list[int], spoken: list[int], rng: random.Random) -> list[tuple[Parts, str | None]]:
    """Examples (labelled parts, question) made from the sound pairs by known edits.

    ``begins`` holds where the clauses of each reply begin, ``spoken`` the language of each question, -1 if unknown.
    """
    out: list[tuple[Parts, str | None]] = []
    by_language: dict[int, list[str]] = {}
    for i in sound:
        if pairs[i][1] and spoken[i] >= 0:
            by_language.setdefault(spoken[i], []).append(pairs[i][1])
    codes = [m for i in sound for m in re.findall(r"```\w*\n(.+?)```", pairs[i][0], re.S)]
    values = [m.group() for i in sound if (m := re.search(r"[\w.,]*\w(?=\W*$)", pairs[i][0][begins[i][-1] :]))]
    for i in sound:
        reply, question = pairs[i]
        ask = unicodedata.normalize("NFKC", question) if question else None
        final = begins[i][-1]
        work: Parts = [(reply[:final], STEP)] if final else []
        whole: Parts = [*work, (reply[final:], ANSWER)]
        others = [k for k in by_language if k != spoken[i]]
        strange = rng.choice(by_language[rng.choice(others)]) if others else None
        out.append((whole, question))
        if values and rng.random() < 0.4:  # the value of another reply
            value = rng.choice(values)
            end = re.sub(r"[\w.,]*\w(?=\W*$)", lambda m: value, reply[final:], count=1)
            out.append(([*work, (end, ANSWER)] if rng.random() < 0.8 else [(value, ANSWER)], question))
        if ask:
            out.append(([(_echo(ask, rng) + rng.choice((" ", "\n", "\n\n")), ECHO), *whole], question))
            out.append(([(_echo(ask, rng), ECHO), (rng.choice(ECHO_TAILS), ECHO)], question))
        cut = _cut_off(reply, rng)
        if cut and not is_empty(cut):
            at = max((b for b in begins[i] if b < len(cut)), default=0)
            parts: Parts = [(cut[:at], STEP), (cut[at:], UNFINISHED)]
            if ask and rng.random() < 0.2:
                parts = [(_echo(ask, rng) + "\n", ECHO), *parts]
            out.append((parts, question))
        parts = [(_refusal(rng, re.findall(r"\b[A-Z][a-z]{3,}\b", reply)), REFUSAL)]
        if rng.random() < 0.15:
            parts = [*work, *parts]
        elif ask and rng.random() < 0.1:
            parts = [(_echo(ask, rng) + "\n", ECHO), *parts]
        out.append((parts, strange if strange and rng.random() < 0.3 else question))
        if strange and rng.random() < 0.6:
            lead: Parts = [(rng.choice(REPLY_LEADS), STEP)] if rng.random() < 0.2 else []
            out.append((lead + [(p, FOREIGN) for p, _ in whole], strange))
        if codes and rng.random() < 0.1:
            code = rng.choice(codes)
            tail = rng.choice(("", "", "return (", "print(", "x = ["))
            part = code[: rng.randrange(1, len(code))].rstrip() + ("\n    " + tail if tail else "")
            out.append(([*work, ("\n```python\n" + part[: part.rfind("\n") + 1], STEP), (part[part.rfind("\n") + 1 :], UNFINISHED)], question))
        if question and spoken[i] >= 0 and rng.random() < 0.3:
            out.append(([(_cipher(reply, rng), FOREIGN)], question))
        if work and strange and rng.random() < 0.2:
            quote = re.split(r"(?<=[.!?])\s+", strange.strip())[0]
            out.append(([*work, (f"(It reads “{quote}”, which does not matter.) ", STEP), whole[-1]], question))
    return out


def _labels_of(c: Clauses, examples: list[tuple[Parts, str | None]]) -> np.ndarray:
    """The label of every clause: that of the part in which its first token lies."""
    y = np.zeros(c.n, dtype=np.int64)
    at = 0
    for i, (parts, _) in enumerate(examples):
        ends = np.cumsum([len(p) for p, _ in parts])
        labels = np.array([k for _, k in parts])
        n = c.per_row[i]
        place = c.begin[at : at + n] - c.row_begin[i]
        y[at : at + n] = labels[np.minimum(np.searchsorted(ends, place, "right"), len(labels) - 1)]
        at += n
    return y


def _vocabulary(d: Described) -> np.ndarray:
    """The most frequent words and word pairs that at least three rows show, sorted."""
    _, once = np.unique(mix(d.hashes ^ mix((d.clauses.row[d.owner].astype(np.uint64) + np.uint64(1)) * PAIR)), return_index=True)
    h, n = np.unique(d.hashes[once], return_counts=True)
    order = np.lexsort((h, -n))[:VOCABULARY]
    return np.sort(h[order][n[order] >= 3])


def train(sample: list[tuple[str, str | None]]) -> Tagger:
    """The models trained on a sample of (reply, question), most of them sound."""
    rng = random.Random(11)
    # a reply given many times over counts once: what is sound differs from question to question, canned words don't
    pairs = list({t: (t, q) for r, q in sample if not is_empty(r) for t in [unicodedata.normalize("NFKC", r).replace("\0", " ")]}.values())
    languages = Languages({k: v for k, v in LANGUAGE_WORDS.items()})
    languages.fit([q for q in dict.fromkeys(q for _, q in pairs) if q] + [r for r, _ in pairs])
    empty = Tagger(languages, np.empty(0, np.uint64), Crf(Described.width(), len(LABELS)))
    if not pairs:
        return empty
    natural = Described([r for r, _ in pairs], [q for _, q in pairs], languages)
    c = natural.clauses
    worst = np.zeros(c.n_rows)
    np.maximum.at(worst, c.row, natural.share * (c.size >= 3))
    usual = (c.per_row > 0) & (worst < 0.3) & ((natural.row_evidence < 3) | (natural.language < 0))
    sound = np.flatnonzero(usual).tolist()
    spoken = natural.language.tolist()
    if not sound:
        return empty
    begin = np.cumsum(c.per_row) - c.per_row
    begins = [(c.begin[b : b + n] - r).tolist() for b, n, r in zip(begin, c.per_row, c.row_begin)]
    model = _fit(edited(pairs, begins, sound[::3], spoken, rng), languages)
    # once more, without the natural replies that the field finds broken, and with the refusals it finds
    tags = model.tags(natural)
    found = decide(natural, tags)
    better = [i for i in sound if found[i] is None and tags[begin[i] + c.per_row[i] - 1] == ANSWER]
    examples = edited(pairs, begins, better or sound, spoken, random.Random(12))
    for i, kind in enumerate(found):
        if kind in ("refusal", "copied_question"):
            cuts = [*begins[i], len(pairs[i][0])]
            parts = [(pairs[i][0][(0 if j == 0 else cuts[j]) : cuts[j + 1]], int(tags[begin[i] + j])) for j in range(len(cuts) - 1)]
            examples += [(parts, pairs[i][1])] * (4 if kind == "refusal" else 1)
    return _fit(examples, languages)


def _fit(examples: list[tuple[Parts, str | None]], languages: Languages) -> Tagger:
    d = Described(["".join(p for p, _ in parts) for parts, _ in examples], [q for _, q in examples], languages)
    vocabulary = _vocabulary(d)
    y = _labels_of(d.clauses, examples)
    field = Crf(d.x.shape[1], len(LABELS), len(vocabulary)).fit(d.sequences(vocabulary), y)
    return Tagger(languages, vocabulary, field)


def broken_pairs(pairs: DataFrame, id_col: str, reply_col: str, question_col: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, defect): empty, truncated, refusal, copied_question or other_language; rows without defect have none.

    A null reply is empty. With a null or blank question only empty, truncated and refusal are told. Every row
    counts for itself; other columns are ignored. The models are trained on at most ``sample_rows`` rows, those of
    the smallest hash of their id, and broadcast (a few megabytes); all rows are then tagged in a narrow pass.
    """
    base = pairs.select(F.col(id_col).alias("k"), F.col(reply_col).alias("r"), F.col(question_col).alias("q"))
    order = F.xxhash64(F.col("k").cast("string"))
    rows = base.where("r is not null").select(order.alias("h"), "r", "q").orderBy("h", "r", "q").limit(sample_rows).toArrow()
    model = train(list(zip(rows.column("r").to_pylist(), rows.column("q").to_pylist())))
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies, questions = b.column(1).to_pylist(), b.column(2).to_pylist()
            kinds = shared.value.defects([r or "" for r in replies], questions)
            found = [(i, "empty" if r is None else d) for i, (r, d) in enumerate(zip(replies, kinds)) if r is None or d]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([d for _, d in found], pa.string())], names=["k", "d"])

    kind = pairs.schema[id_col].dataType.simpleString()
    return base.mapInArrow(run, f"k {kind}, d string").toDF(id_col, "defect")
