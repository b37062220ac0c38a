"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) are found by scans that take linear time on any text. The field is trained on
the driver from a small labelled table (a few hundred short sentences, ``labelled_table``) by gradient ascent on the
penalised likelihood; its weights go to the tasks, which decode by Viterbi, all texts of a batch at once in numpy.
It adds what the patterns miss: secrets after a cue, numbers written without a plus sign, addresses spelt out.

Every word of a text is decoded, in its whole text. Only texts without any digit, ``@``, ``dot`` or a secret's cue (in small or capital
letters) are passed over: no added span in them could be plausible (see ``plausible``), but for a secret of letters only that
nothing points to. A word's features and its neighbours' add up, so each distinct word has one row of scores
for each distance, and a text's scores are gathered from these. Long texts are dealt into pieces of ``PIECE`` words that advance
together: a first pass gives for each piece the best score from any tag before it to any tag at its end, these are
chained, and a second pass decodes every piece from its true beginning, so the result is that of the whole text. An added span
that touches fixed ones is cut at them.

Nothing is shuffled. Defined results: null and empty texts have no spans; repeated rows each get their row; null ids
are carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import Words, ids_and_text, mapped
from .quality_rules import byte_counts

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words of a text that are decoded in turn; its pieces advance side by side.
PIECE = 256
#: Distances of the words whose features count at a place, and distinct words whose scores a task remembers.
NEAR, REMEMBERED = (0, -2, -1, 1, 2), 100_000
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long"

# ---- fixed patterns

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts, start = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    doubled = [int(x) * 2 for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in doubled)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in CARD.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PHONE.finditer(text):
        if 10 <= sum("0" <= x <= "9" for x in run.group()) <= 15:
            yield run.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    return sorted((a, k, b) for k, f in enumerate((emails, ips, cards, phones)) for a, b in f(text))


# ---- the labelled table

CUES = {
    "secret": ("token", "secret", "password", "api_key", "apikey", "key", "passwd", "pwd", "credential"),
    "phone": ("call", "phone", "tel", "mobile", "fax"),
    "email": ("mail", "email", "e-mail", "write", "contact"),
    "card": ("card", "visa", "iban"),
    "ip": ("host", "server", "address"),
}
SYLLABLES = ("the", "er", "on", "an", "th", "in", "de", "la", "que", "ción", "ment", "ung", "keit", "eau", "st", "es", "or", "and")


def labelled_sentences(n: int = 640, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Sentences of made-up words with personal data and look-alikes among them, and a tag for each word.

    ``n`` short ones, and a twelfth as many of 40 to 80 words: these show that a name does not run on through ordinary text.
    """
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))
    code = lambda k, letters="0123456789abcdef": "".join(r.choice(letters) for _ in range(k))
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    end = lambda: r.choice(("", "", "", ",", "."))

    def secret() -> tuple[list[str], list[str]]:
        value = r.choice((lambda: code(40), lambda: code(32), lambda: code(r.randint(20, 44), mixed), lambda: "sk-" + code(r.randint(16, 28), mixed), lambda: "sk-" + code(r.randint(16, 28), mixed.lower()), lambda: "AKIA" + code(16, mixed.upper()), password, password, password))()
        if r.random() < 0.15:
            value = lettered()
        quote, cue = r.choice(('"', "'", "", "")), r.choice(CUES["secret"])
        cue = r.choice((cue, cue.capitalize(), cue.upper()))
        if r.random() < 0.15:
            return [cue + r.choice("=:") + quote + value + quote + end()], ["B-secret"]
        if r.random() < 0.12 and len(value) >= 14:
            after = r.choice((["is", "my"], ["is", "the"], ["is", "our", word()], ["is", "my", word()], ["was", "the"]))
            return [quote + value + quote, *after, cue.lower() + end()], ["B-secret", *["O"] * (len(after) + 1)]
        words = r.choice(([cue, "="], [cue, ":"], [cue, "is"], [cue + ":"], [cue + "="], [cue]))
        return [*words, quote + value + quote + end()], [*["O"] * len(words), "B-secret"]

    def lettered() -> str:
        return r.choice((lambda: code(r.randint(20, 40), "abcdef"), lambda: "".join(word() for _ in range(9))[: r.randint(18, 30)], lambda: code(r.randint(18, 32), mixed[:52]), lambda: "-".join(word() for _ in range(5))))()

    def password() -> str:
        inner = list(word() + digits(r.randint(1, 4)) + code(r.randint(3, 6), mixed + "&!_-"))
        if r.random() < 0.5:
            r.shuffle(inner)
        return "x" + "".join(inner) if r.random() < 0.5 else "".join(inner) + "7z"

    def phone() -> tuple[list[str], list[str]]:
        parts = r.choice((lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"], lambda: [digits(2) for _ in range(5)], lambda: ["0" + digits(4), digits(6)], lambda: ["0" + digits(3), digits(3), digits(4)], lambda: [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"+{digits(2)}", digits(3), digits(3), digits(4)]))()
        cue = [r.choice(CUES["phone"]) + r.choice(("", "", ":"))] if len(parts[0]) in (2, 4, 5) or r.random() < 0.4 else []
        parts[-1] += end()
        return [*cue, *parts], [*["O"] * len(cue), "B-phone", *["I-phone"] * (len(parts) - 1)]

    def email() -> tuple[list[str], list[str]]:
        kind = r.random()
        if kind < 0.5:
            return [f"{word()}.{digits(2)}@mail{digits(1)}.example.com{end()}"], ["B-email"]
        if kind < 0.6:
            return [f"{word()}@{word()}.org{end()}"], ["B-email"]
        at, dot = r.choice((("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")))
        cue = [r.choice(CUES["email"])] if r.random() < 0.6 else []
        if r.random() < 0.25:
            return [*cue, word().upper(), at.upper(), word().upper(), dot.upper(), r.choice(("COM", "ORG", "NET")) + end()], [*["O"] * len(cue), "B-email", *["I-email"] * 4]
        return [*cue, word(), at, word(), dot, r.choice(("com", "org", "net")) + end()], [*["O"] * len(cue), "B-email", *["I-email"] * 4]

    def card() -> tuple[list[str], list[str]]:
        parts = [digits(4) for _ in range(4)] if r.random() < 0.6 else ["-".join(digits(4) for _ in range(4))]
        parts[-1] += end()
        return [r.choice(CUES["card"]), *parts], ["O", "B-card", *["I-card"] * (len(parts) - 1)]

    def ip() -> tuple[list[str], list[str]]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4)) + end()], ["B-ip"]

    def alike() -> tuple[list[str], list[str]]:
        value = r.choice((lambda: [str(r.randint(1900, 2030))], lambda: [f"{r.randint(1, 999)}.{digits(2)}"], lambda: [f"{digits(1)},{digits(3)}"], lambda: [digits(r.randint(1, 5))], lambda: [digits(r.randint(12, 18))], lambda: [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"], lambda: [f"1{digits(1)}:{digits(2)}"], lambda: [f"v{digits(1)}.{digits(1)}.{digits(1)}"] * r.randint(1, 4), lambda: [f"v{digits(1)}.{digits(1)}.{digits(1)}" for _ in range(r.randint(1, 3))], lambda: [f"#{digits(6)}"], lambda: [word() + digits(2)], lambda: [code(r.choice((7, 12, 40)))], lambda: ["at", word()], lambda: ["key", "of", word()], lambda: ["the", "token", word()], lambda: ["the", r.choice(CUES["secret"]), (word() + word() + word())[:14]], lambda: [(word() + word())[:15], "is", "the", r.choice(CUES["secret"])], lambda: [r.choice(CUES["secret"]), "is", word()], lambda: [r.choice(CUES["secret"]), digits(r.randint(1, 4))], lambda: ["call", word()], lambda: ["@" + word()], lambda: [digits(3) + "-" + digits(1)], lambda: [digits(1), digits(2), digits(1)]))()
        value[-1] += end()
        return value, ["O"] * len(value)

    out = []
    for k in range(n):
        words, tags = [], []
        for _ in range(r.randint(1, 2)):
            fill = [word() + end() for _ in range(r.choice((0, 0, 1, 2, 3, 5)))]
            some = (secret, phone, email, card, ip, alike, alike, alike)[(k + _) % 8]()
            words += fill + some[0]
            tags += ["O"] * len(fill) + some[1]
        fill = [word() + end() for _ in range(r.randint(0, 4))]
        out.append((words + fill, tags + ["O"] * len(fill)))

    def ordinary() -> str:
        kind = r.random()
        return r.choice(("|", "-", "#", "*")) if kind < 0.06 else word().capitalize() + end() if kind < 0.15 else word() + end()

    for k in range(n // 12):
        words, tags = [], []
        while len(words) < 40:
            fill = [ordinary() for _ in range(r.randint(8, 30))]
            some = (secret, alike, phone, alike, email, alike, card, ip)[r.randrange(8)]()
            words += fill + some[0]
            tags += ["O"] * len(fill) + some[1]
        fill = [ordinary() for _ in range(r.randint(0, 20))]
        out.append((words + fill, tags + ["O"] * len(fill)))
    return out


def labelled_table(spark: SparkSession, n: int = 640, seed: int = 11) -> DataFrame:
    """The labelled table as rows: sentence, place, word, tag."""
    return spark.createDataFrame([(s, i, w, t) for s, (words, tags) in enumerate(labelled_sentences(n, seed)) for i, (w, t) in enumerate(zip(words, tags, strict=True))], "sentence int, place int, word string, tag string")


# ---- the field

NAMED = frozenset(x for xs in CUES.values() for x in xs) | {"at", "dot", "(at)", "(dot)", "[at]", "[dot]", "=", ":", "is", "my", "our", "com", "org", "net"}
EDGE = "\"'.,;:!?#*$%&|<>"
#: A secret's cue and its sign at the beginning of the word that has the secret.
CUED = re.compile(f"(?i:{'|'.join(CUES['secret'])})[=:]+[\"']?(?=.{{8}})")


def shape(word: str) -> str:
    """Kinds of characters with runs squeezed: (636) -> (9), mail4@x.com -> x9@x.x"""
    out = re.sub("[0-9]+", "9", re.sub("[^\\W\\d_a-z]+", "X", re.sub("[a-zß-öø-ÿ]+", "x", word)))
    return out if len(out) <= 14 else "long:" + "".join(sorted(set(out)))[:8]


def word_features(word: str) -> list[str]:
    bare = word.strip(EDGE)
    digits = sum("0" <= x <= "9" for x in bare)
    out = ["shape=" + shape(bare), f"digits={min(digits, 20)}", f"quoted={word[:1] in '\"\'' and word[:1] != ''}", f"size={min(len(bare), 48) // 4}"]
    if bare.lower() in NAMED or word in NAMED:
        out.append("word=" + (word if word in NAMED else bare.lower()))
    if len(bare) >= 16 and digits and re.fullmatch(r"[A-Za-z0-9_-]+", bare) and not bare.isdigit():
        out.append("code")
    elif len(bare) >= 16 and re.fullmatch(r"[A-Za-z_-]+", bare):
        out.append("letters")
    elif 8 <= len(bare) and re.search(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]", bare) and "@" not in bare:
        out.append("mixed")
    if cue := CUED.match(bare):
        out.append("cued")
        if re.fullmatch(r"[A-Za-z0-9_-]{16,}", bare[cue.end() :].strip(EDGE)):
            out[1] = "digits=cued"  # what is in a long code after its cue says little
            out.append("cued code")
    if "@" in bare:
        out.append("at")
    return out


def features(words: list[str], known: dict[str, list[str]]) -> list[list[str]]:
    """Of each word: its own, and its neighbours' with their distance."""
    own = [known.get(w) or known.setdefault(w, word_features(w)) for w in words]
    out = []
    for i in range(len(words)):
        row = ["bias", *own[i]]
        for d in (-2, -1, 1, 2):
            j = i + d
            near = own[j] if 0 <= j < len(words) else ["edge"]
            row += [f"{d}{x}" for x in near if x[:4] != "size"]
        out.append(row)
    return out


class Field:
    """Weights of a linear-chain field; row 0 of the emission weights stands for unknown features."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def ids(self, words: list[str], known: dict[str, list[str]], cache: dict | None = None) -> list[list[int]]:
        get = self.names.get
        return [[k for x in row if (k := get(x))] for row in features(words, known)]

    def scores(self, sentences: list[list[list[int]]], length: int) -> np.ndarray:
        wide = max(max(map(len, s)) for s in sentences)
        at = np.zeros((len(sentences), length, wide), np.int32)
        for i, s in enumerate(sentences):
            for j, row in enumerate(s):
                at[i, j, : len(row)] = row
        return self.emit[at].sum(axis=2)

    def decode(self, sentences: list[list[list[int]]]) -> list[np.ndarray]:
        """Best tags of each sentence, by Viterbi over sentences of about one length at a time."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(sentences)
        order = sorted(range(len(sentences)), key=lambda i: len(sentences[i]))
        while order:
            top = max(16, len(sentences[order[0]]) * 5 // 4)
            chunk = []
            while order and len(sentences[order[0]]) <= top and len(chunk) < 256:
                chunk.append(order.pop(0))
            sizes = np.array([len(sentences[i]) for i in chunk])
            length = int(sizes.max())
            score = self.scores([sentences[i] for i in chunk], length)
            best, back = score[:, 0] + START, np.zeros((len(chunk), length, len(TAGS)), np.int8)
            for t in range(1, length):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(axis=1)
                best = np.where((t < sizes)[:, None], step.max(axis=1) + score[:, t], best)
            for row, i in enumerate(chunk):
                tag, path = int(best[row].argmax()), []
                for t in range(sizes[row] - 1, -1, -1):
                    path.append(tag)
                    tag = int(back[row, t, tag])
                out[i] = np.array(path[::-1])
        return out

    def word_scores(self, own: tuple[str, ...]) -> np.ndarray:
        """What a word with these features adds to each tag's score at its own place, and at the places that see it at each distance."""
        get, out = self.names.get, np.zeros((len(NEAR), len(TAGS)))
        out[0] = self.emit[[get(x, 0) for x in ("bias", *own)]].sum(axis=0)
        for k, d in enumerate(NEAR[1:], 1):
            out[k] = self.emit[[get(f"{d}{x}", 0) for x in own if x[:4] != "size"]].sum(axis=0)
        return out

    def step(self, best: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """Best score of each next tag (before its own score) from scores by (..., tag, piece); back gets the tag it comes from."""
        out = best[..., 0, None, :] + self.move[0][:, None]
        for k in range(1, len(TAGS)):
            other = best[..., k, None, :] + self.move[k][:, None]
            if back is not None:
                np.copyto(back, k, where=other > out)
            np.maximum(out, other, out=out)
        return out

    def decode_texts(self, scores: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tag of every word. scores: word_scores of each distinct word, the text's edge last. code: each word's row there.
        first: each text's first word, with the total at the end.
        """
        n, tags, length = len(code), len(TAGS), np.diff(first)
        count = -(-length // PIECE)
        text = np.repeat(np.arange(len(length)), count)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = first[text] + rank * PIECE
        size = np.minimum(PIECE, first[text + 1] - begin)
        opens, followed = rank == 0, rank + 1 < count[text]
        at = np.arange(n) + 2 * (np.repeat(np.arange(len(length)), length) + 1)
        laid = np.full(n + 2 * len(length) + 2, len(scores) - 1)
        laid[at] = code
        columns = [np.ascontiguousarray(scores[:, k].T) for k in range(len(NEAR))]
        own = lambda places: sum(c[:, laid[at[places] + d]] for c, d in zip(columns, NEAR, strict=True))

        def longest_first(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The pieces by falling size, their beginnings, and how many of them have a word at each step."""
            pieces = pieces[np.argsort(-size[pieces], kind="stable")]
            return pieces, begin[pieces], len(pieces) - np.searchsorted(size[pieces][::-1], np.arange(size[pieces].max(initial=0)), "right")

        entry = np.zeros((tags, len(text)))
        pieces, starts, live = longest_first(np.flatnonzero(followed))
        if len(pieces):
            passed = np.where(opens[pieces], START[None, :, None], self.move[:, :, None]) + own(starts)
            for t in range(1, len(live)):
                passed = self.step(passed) + own(starts + t)
            place = np.empty(len(text), int)
            place[pieces] = np.arange(len(pieces))
            for p in np.flatnonzero(followed):
                entry[:, p + 1] = (entry[:, p, None] + passed[:, :, place[p]]).max(axis=0)
        pieces, starts, live = longest_first(np.arange(len(text)))
        back = np.zeros((n, tags), np.int8)
        best = entry[:, pieces]
        for t, k in enumerate(live):
            come = np.zeros((tags, k), np.int8)
            ahead = self.step(best[:, :k], come)
            if t == 0:
                ahead = np.where(opens[pieces], START[:, None], ahead)
            best[:, :k] = ahead + own(starts[:k] + t)
            back[starts[:k] + t] = come.T
        ends = np.empty(len(text), int)
        ends[pieces] = best.argmax(axis=0)
        later, later_starts, later_live = longest_first(np.flatnonzero(~opens))
        if len(later):
            before = np.repeat(np.arange(tags)[:, None], len(later), axis=1)
            for t in range(len(later_live) - 1, -1, -1):
                k = later_live[t]
                before[:, :k] = back[later_starts[:k] + t, before[:, :k]]
            place[later] = np.arange(len(later))
            for p in np.flatnonzero(~opens)[::-1]:
                ends[p - 1] = before[ends[p], place[p]]
        out, tag = np.empty(n, np.int8), ends[pieces]
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            out[starts[:k] + t] = tag[:k]
            tag[:k] = back[starts[:k] + t, tag[:k]]
        return out

    def decode_words(self, words: Words, known: dict[str | tuple, np.ndarray]) -> np.ndarray:
        """Best tag of every word of the texts; known remembers the scores of words and of lists of features."""
        code, distinct = words.coded()
        if len(known) > REMEMBERED:
            known.clear()
        for w in distinct.to_pylist():
            if w not in known:
                own = tuple(word_features(w))
                if own not in known:
                    known[own] = self.word_scores(own)
                known[w] = known[own]
        rows = [known[w] for w in distinct.to_pylist()]
        return self.decode_texts(np.stack([*rows, self.word_scores(("edge",))]), code, words.first)

    def decode_long(self, words: list[str], known: dict) -> np.ndarray:
        """Best tags of one sentence of any length."""
        return self.decode_words(Words(pa.array([" ".join(words)])), known)


#: Moves that a tagging cannot make: inside without the same name before it.
ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in TAGS] for a in TAGS])
START = np.where([t.startswith("I-") for t in TAGS], -1e4, 0.0)


def train(sentences: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.2, penalty: float = 0.02) -> Field:
    """Adam on the mean log likelihood less a quadratic penalty, all sentences at once by forward and backward sums."""
    sentences = sorted(sentences, key=lambda s: -len(s[0]))
    known: dict[str, list[str]] = {}
    rows = [features(words, known) for words, _ in sentences]
    names: dict[str, int] = {}
    for s in rows:
        for row in s:
            for x in row:
                names.setdefault(x, len(names) + 1)
    size = np.array([len(s) for s in rows])
    n, length, k = len(rows), int(size[0]), len(TAGS)
    live = np.arange(length) < size[:, None]
    inner, many = live[:, 1:], live.sum(axis=0)
    wide = max(len(row) for s in rows for row in s)
    at, gold = np.zeros((int(size.sum()), wide), np.int64), np.zeros((n, length), int)
    for cell, row in enumerate(row for s in rows for row in s):
        at[cell, : len(row)] = [names[x] for x in row]
    gold[live] = [TAGS.index(t) for _, tags in sentences for t in tags]
    flat, cell, of = at.ravel(), np.repeat(np.arange(len(at)), wide), np.nonzero(live)[0]
    emit, move = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, rounds + 1):
        score, ahead, behind = np.zeros((3, n, length, k))
        score[live] = emit[at].sum(axis=1)
        way = np.where(ALLOWED, move, -1e4)
        ahead[:, 0] = score[:, 0] + START
        for t in range(1, length):
            m = many[t]
            ahead[:m, t] = total(ahead[:m, t - 1, :, None] + way, 1) + score[:m, t]
        for t in range(length - 2, -1, -1):
            m = many[t + 1]
            behind[:m, t] = total(way + (score[:m, t + 1] + behind[:m, t + 1])[:, None, :], 2)
        whole = total(ahead[np.arange(n), size - 1], 1)
        share = np.exp(ahead[live] + behind[live] - whole[of][:, None])
        share[np.arange(len(share)), gold[live]] -= 1
        down = np.stack([np.bincount(flat, weights=share[cell, c], minlength=len(emit)) for c in range(k)], axis=1)
        both = ahead[:, :-1][inner][:, :, None] + way + (score[:, 1:] + behind[:, 1:])[inner][:, None, :] - whole[np.nonzero(inner)[0]][:, None, None]
        moves = np.exp(both).sum(axis=0) - true_moves
        for x, g, m, v in ((emit, down / n + penalty * emit / 10, state[0], state[1]), (move, moves / n + penalty * move / 10, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        emit[0] = 0
    keep = {x: i for x, i in names.items() if np.abs(emit[i]).max() > 1e-3}
    place = {x: i + 1 for i, x in enumerate(keep)}
    return Field(place, np.vstack([np.zeros(k), emit[list(keep.values())]]), np.where(ALLOWED, move, -1e4))


def trained(spark: SparkSession, table: DataFrame | None = None) -> Field:
    """The field learnt from a labelled table (sentence, place, word, tag); by default labelled_table, of a few hundred sentences."""
    rows = (labelled_table(spark) if table is None else table).orderBy("sentence", "place").collect()
    sentences: dict[int, tuple[list[str], list[str]]] = {}
    for r in rows:
        words, tags = sentences.setdefault(r["sentence"], ([], []))
        words.append(r["word"])
        tags.append(r["tag"])
    return train(list(sentences.values()))


def named(text: str, words: list[tuple[int, int]], tags: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of each tagged name, without quotes and stops around it."""
    i = 0
    while i < len(tags):
        if tags[i] == 0:
            i += 1
            continue
        kind, j = (tags[i] - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 * kind + 2:
            j += 1
        start, end = words[i][0], words[j - 1][1]
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        if end > start:
            yield start, kind, end
        i = j


def plausible(kind: int, name: str) -> bool:
    """Digits of an added card pass Luhn, an added phone has 7 to 15 of them, an added mail address has its signs, an added ip small parts, and an added secret eight characters or more that are not all digits."""
    digits = re.sub("[^0-9]", "", name)
    if KINDS[kind] == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind] == "phone":
        return 7 <= len(digits) <= 15
    if KINDS[kind] == "email":
        return "@" in name or bool(re.search(r"\bat\b.*\bdot\b", name, re.I))
    if KINDS[kind] == "secret":
        return len(name) >= 8 and len(digits) < len(name)
    return KINDS[kind] != "ip" or next(ips(name), None) == (0, len(name))


def outside(start: int, end: int, taken: list[tuple[int, int]], firsts: list[int], text: str) -> Iterator[tuple[int, int]]:
    """What the disjoint, ordered spans in taken leave of a span, without spaces, quotes and stops around it."""
    k = max(0, bisect.bisect_right(firsts, start) - 1)
    while start < end:
        a, b = taken[k] if k < len(taken) else (end, end)
        k += 1
        low, high = start, min(max(a, start), end)
        while low < high and (text[low] in EDGE or text[low].isspace()):
            low += 1
        while high > low and (text[high - 1] in EDGE or text[high - 1].isspace()):
            high -= 1
        if high > low:
            yield low, high
        start = max(start, b)


def joined_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The disjoint union of (start, kind, end) in order of start."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


#: What a text without a digit or an @ must have to be looked into: a spelt address's dot, or a secret's cue.
HINTS = "(?i)dot|" + "|".join(CUES["secret"])
SEEN = np.zeros(256, np.int64)
SEEN[list(b"0123456789@")] = 1


def find(texts: pa.Array, field: Field, known: dict[str | tuple, np.ndarray]) -> dict[str, list]:
    some = byte_counts(texts, SEEN) > 0
    some |= pc.fill_null(pc.match_substring_regex(texts, HINTS), False).to_numpy(zero_copy_only=False)
    base: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    chosen = np.flatnonzero(some)
    words = Words(texts.take(pa.array(chosen)))
    tags = field.decode_words(words, known)
    marked = set(words.doc[tags > 0].tolist())
    for row, i in enumerate(chosen.tolist()):
        text = texts[i].as_py()
        base[i] = base_spans(text)
        if row not in marked:
            continue
        union = joined_spans(base[i])
        firsts = [a for a, _ in union]
        for a, kind, b in named(text, [m.span() for m in WORD.finditer(text)], tags[words.first[row] : words.first[row + 1]].tolist()):
            cue = CUED.match(text, a, b) if KINDS[kind] == "secret" else None
            spans[i] += [(x, kind, y) for x, y in outside(cue.end() if cue else a, b, union, firsts, text) if plausible(kind, text[x:y])]
    added = [len(xs) for xs in spans]
    secrets = [sum(k == 4 for _, k, _ in xs) for xs in spans]
    joined = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(xs))
    out = {f"n_{kind}": [sum(k == n for _, k, _ in xs) for xs in base] for n, kind in enumerate(KINDS[:4])}
    return out | {"base_sha256": [hashlib.sha256(joined(xs).encode()).hexdigest() for xs in base], "spans": [joined([*a, *b]) for a, b in zip(base, spans, strict=True)], "n_added": added, "n_secret": secrets}


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """One row of SCHEMA per row of docs."""
    field = trained(docs.sparkSession, labelled)

    def make():
        known: dict[str | tuple, np.ndarray] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.string() if k in ("spans", "base_sha256") else pa.int64()) for k, v in find(batch.column("text"), field, known).items()})

        return work

    return mapped(ids_and_text(docs, id_col, text_col), make, SCHEMA)
