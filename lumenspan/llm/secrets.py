"""Secrets in texts: base patterns, and spans that a conditional random field adds.

Tokens are the words of a text. A linear-chain CRF tags each as the beginning of a
secret, its inside, or outside, by the word's own shape, its two neighbours' and two
features of the whole file; Viterbi's recursion gives the best tags. The model is
trained by the driver on sequences made here from a seed, whose secrets are of many
known forms and whose other tokens are prose, numbers, checksums, addresses and other
things that look like secrets.

Almost all words of a text are plain: words of letters for which being outside beats
the other tags by more than any transitions around them can make up. The features of
a short word of letters say nothing of its neighbours, unless it stands after a cue, a
sign or an open name; such words, and long, joined or mixed ones, have all features, and
each is held against that bound where it stands. The best sequence is outside at plain
words, so it falls into independent stretches between them, and only those are decoded.
That is the exact result, found without running the recursion over every word. A file
with a block of a key in it is decoded in full.
"""

from __future__ import annotations

import functools
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame

from . import crf
from . import spans as S

KINDS = ("assign", "access", "hex", "crf")
ASSIGN, ACCESS, HEX, TAGGED = range(4)
OUTSIDE, BEGIN, INSIDE = range(3)


def _either(word: str) -> str:
    """A pattern for ASCII letters in either case; IGNORECASE would match a few others too."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAME = re.compile(_NAMES)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")


def base(text: str) -> list[S.Span]:
    """Matches of the base patterns; those that fail a kind's test are dropped."""
    found = [(ASSIGN, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(ACCESS, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(HEX, m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


# How well-known services begin their keys.
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "xoxa-", "AIza", "ya29.", "SG.", "npm_", "dop_v1_", "hf_", "eyJ", "ASIA", "sk-", "shpat_", "key-", "pypi-")
CUES = frozenset("password passwd pwd passphrase secret token bearer basic authorization apikey api_key api-key key keys credential credentials auth access private client_secret access_key secret_key signing".split())
DECOYS = frozenset("commit sha sha1 sha256 md5 checksum hash digest uuid id etag revision integrity version isbn order invoice phone tel".split())
#: A word of letters, at most 40 in a row, with marks around and hyphens or apostrophes inside, or of marks alone.
_LETTERS = re.compile(r"[^\w]*(?:[^\W\d_]{1,40}(?:['’-][^\W\d_]{1,40})*[^\w]*)?")
# str.split() and this pattern agree on what white space is but for U+001C to U+001F, which split() alone takes.
_WORDS = re.compile(r"[^\s\x1c-\x1f]+")
_MIXED = re.compile(r"[a-z][A-Z].*[a-z][A-Z]")
SIGNS = ("=", ":", "is", "->", "=>")
_CORE = re.compile(r"""^[\["'`({<,;]*|[\]"'`)}>,;.!?:]*$""")
_KEY = re.compile(r"^[A-Za-z_.-]{2,40}[\"']?\s?(?:=|:(?!//))[\"']?")
_USER = re.compile(r"^[a-z][a-z0-9+.-]*://[^/\s:@]+:([^/\s@]+)@")
_FENCE = re.compile(r"-{4,5}(BEGIN|END)")


def core(word: str) -> tuple[int, int]:
    """The part of a word that could be a secret: without quotes, a name before "=" or ":", or an address around it."""
    a, b = _CORE.match(word).end(), len(word)
    while b > a and word[b - 1] in "]\"'`)}>,;.!?:":
        b -= 1
    if m := _USER.match(word[a:b]):
        return a + m.start(1), a + m.end(1)
    if m := _KEY.match(word[a:b]):
        if word[a + m.end() : b].strip("="):
            a += m.end()
    return a, b


#: What joins the letters of one word.
MARKS = "-'’"


def unusual(word: str) -> bool:
    """Whether a word of letters is long, joined twice or of mixed case, as prose seldom is."""
    return len(word) >= 16 or sum(map(word.count, MARKS)) >= 2 or bool(_MIXED.search(word))


def opens(word: str) -> bool:
    """Whether a secret may come after a word: a cue, a sign or an open name."""
    return word[-1] in "=:" or word in SIGNS or word.lower().strip("\"'`:=,;.()[]{}<>") in CUES


def letters(word: str) -> tuple[str, ...]:
    """Features of a word of letters; there are few combinations of them."""
    bare = word.strip("\"'`:=,;.()[]{}<>").lower()
    kind = "lower" if word.islower() else "upper" if word.isupper() else "other"
    found = ("bias", "letters", f"letters {kind}")
    if unusual(word):
        turns = sum(x.islower() and y.isupper() for x, y in zip(word, word[1:], strict=False))
        found += ("unusual", f"letters length {min(len(bare) // 8, 5)}", f"joined {min(sum(map(bare.count, MARKS)), 3)}", f"case turns {min(turns // 2, 4)}")
    if bare in CUES or bare in DECOYS:
        found += ("cue" if bare in CUES else "decoy",)
    return found + ("ends open",) if word[-1] in "=:" else found


def shape(word: str) -> list[str]:
    """Features of a word's own form."""
    if _LETTERS.fullmatch(word) and not _FENCE.match(word):
        return list(letters(word))
    a, b = core(word)
    body = word[a:b]
    lower = word.lower().strip("\"'`:=,;.()[]{}<>")
    found = ["bias"]
    if body.isalpha():
        found.append("letters inside")
    elif body:
        digits, uppers, lowers = (sum(map(f, body)) for f in (str.isdigit, str.isupper, str.islower))
        marks = len(body) - digits - uppers - lowers
        found.append(f"length {min(len(body) // 8, 5)}")
        found.append("all digits" if digits + marks == len(body) else f"mix {digits > 0:d}{uppers > 0:d}{lowers > 0:d}")
        turns = sum((x.isdigit() != y.isdigit()) + (x.isupper() != y.isupper() and x.isalpha() and y.isalpha()) for x, y in zip(body, body[1:], strict=False))
        found.append(f"turns {min(turns // 3, 5)}")
        found.append(f"marks {min(marks * 8 // len(body), 4)}")
        if all(c in string.hexdigits for c in body):
            found.append(f"hexadecimal {min(len(body) // 8, 5)}")
        elif all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-" for c in body):
            found.append(f"base64 {min(len(body) // 8, 5)}")
        if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", body):
            found.append("uuid")
        if "@" in body or "://" in body:
            found.append("address")
    for p in PREFIXES:
        if body.startswith(p) and len(body) >= len(p) + 12:
            found.append("known prefix")
    if _USER.match(word):
        found.append("password in address")
    if m := _KEY.match(word):
        name = m[0].strip("\"'=: ").lower()
        if any(c in name for c in ("pass", "pwd", "secret", "token", "key", "auth", "cred")):
            found.append("named by cue")
        elif any(c in name for c in DECOYS):
            found.append("named by decoy")
        else:
            found.append("named")
    if m := _FENCE.match(word):
        found.append(f"fence {m[1]}")
    if lower in CUES:
        found.append("cue")
    if lower in DECOYS:
        found.append("decoy")
    if word[-1] in "=:":
        found.append("ends open")
    return found


def beside(word: str | None) -> str:
    """What a word looks like from its neighbour."""
    if word is None:
        return "edge"
    if m := _FENCE.match(word):
        return f"fence {m[1]}"
    lower = word.lower().strip("\"'`:=,;.()[]{}<>")
    if lower in CUES:
        return "cue open" if word[-1] in "=:" else "cue"
    if lower in DECOYS:
        return "decoy"
    if word in SIGNS:
        return "sign"
    a, b = core(word)
    body = word[a:b]
    if word[-1] in "=:" and body.isalpha():
        return "open"
    return "plain" if body.isalpha() else "long" if len(body) >= 24 and any(map(str.isdigit, body)) else "other"


def file_features(text: str) -> list[str]:
    """Whether a file looks like code or settings, and whether it holds a block of a key."""
    signs = sum(text.count(c) for c in "={};")
    return [f"file signs {0 if signs * 200 < len(text) else 1}", f"file block {'-----BEGIN' in text:d}"]


def features(words: list[str], t: int, whole: list[str]) -> list[str]:
    """All features of a word. Usual ones of letters have neighbours only after a word that opens, or in a file with a block."""
    own = shape(words[t])
    if own[1:2] == ["letters"] and whole[1] == "file block 0" and not unusual(words[t]) and not (t and opens(words[t - 1])):
        return [*own, whole[1]]
    if whole[1] == "file block 1":
        own = [f"{n} near block" for n in own]
    before = beside(words[t - 1] if t else None)
    two = beside(words[t - 2] if t > 1 else None) if before in ("sign", "cue open") else "-"
    after = beside(words[t + 1] if t + 1 < len(words) else None)
    return [*own, f"before {before} {two}", f"after {after}", *whole]


def examples(seed: int = 5, count: int = 1400) -> list[list[tuple[list[str], int]]]:
    """Labelled sequences: prose with and without secrets and with what looks like them."""
    r = random.Random(seed)
    parts = "an be co de el en er ge he in ie la lo me na on or qu re se st te th tion un ver wh ai é ñ ü ch sch mente eau".split()
    draw = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    mixed, hexed = string.ascii_letters + string.digits, "0123456789abcdef"

    def prose() -> str:
        word = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
        form = r.random()
        word = word.title() if form < 0.15 else word.upper() + "!!" if form < 0.2 else word
        return word + (r.choice(",.;:!?") if r.random() < 0.15 else r.choice(["###", "$$$", "%%%", "&&&", "***"]) if r.random() < 0.05 else "")

    def word() -> str:
        return "".join(r.choice(parts[:-4]) for _ in range(r.randint(1, 4)))

    def decoy() -> list[str]:
        return r.choice([
            lambda: [r.choice(["commit", "sha256", "md5:", "checksum", "digest:", "etag"]), draw(hexed, 7, 64)],
            lambda: [draw(string.digits, 1, 20)], lambda: [f"{draw(string.digits, 1, 4)}.{draw(string.digits, 1, 3)}"],
            lambda: ["id", "-".join(draw(hexed, n, n) for n in (8, 4, 4, 4, 12))],
            lambda: [f"{draw(string.ascii_lowercase, 3, 9)}.{draw(string.digits, 2, 2)}@mail{r.randint(1, 9)}.example.com"],
            lambda: [f"https://www.example.com/{draw(string.ascii_lowercase, 3, 12)}/{draw(mixed, 3, 12)}"],
            lambda: [f"+{r.randint(1, 99)}", f"({draw(string.digits, 3, 3)})", f"555-{draw(string.digits, 4, 4)}"],
            lambda: [f"20{draw(string.digits, 2, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"], lambda: ["version", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}"],
            lambda: [r.choice(["the", "a", "your", "new"]), r.choice(["password", "token", "secret", "key"]), prose()],
            lambda: [r.choice(["token:", "password:", "key:"]), prose()], lambda: [f"{prose()}={draw(string.digits, 1, 4)}"],
            lambda: [f"{draw(string.ascii_lowercase, 3, 8)}_{draw(string.ascii_lowercase, 3, 8)}({draw(string.ascii_lowercase, 1, 4)})"],
            lambda: [f"{prose()}-{prose()}"], lambda: [f"{prose()}.{prose()}"], lambda: [f"{prose()}.{prose()}!!".upper()], lambda: [prose() + prose() + prose()], lambda: ["|", prose(), "|"], lambda: [prose() + draw(string.digits, 1, 3)],
            lambda: [f"{draw(string.ascii_uppercase, 2, 4)}-{draw(string.digits, 3, 6)}"],
            lambda: [r.choice(["the", "a", "your"]), r.choice(["password", "passphrase", "token", "secret", "key", "authorization"]), "is", word()],
            lambda: [word(), "is", prose()], lambda: [f"{word()}:", prose()], lambda: [r.choice(["basic", "private", "access", "key"]), word()],
            lambda: [prose().lower() + "".join(word().title() for _ in range(r.randint(1, 4)))], lambda: ["-".join(word() for _ in range(r.randint(3, 4)))],
        ])()

    def secret() -> tuple[list[str], list[int]]:
        value = lambda: draw(mixed + "+/", 20, 44) + r.choice(["", "", "=", "=="])
        quote = lambda x: r.choice([x, f'"{x}"', f"'{x}'"])
        words = r.choice([
            lambda: [r.choice(PREFIXES) + draw(mixed, 20, 40)], lambda: ["Bearer", value()], lambda: ["Authorization:", "Basic", value()],
            lambda: [r.choice(["aws_secret_access_key", "client_secret", "private_key", "signing_key", "access_key"]), r.choice(["=", ":"]), quote(value())],
            lambda: [f"{r.choice(['client_secret', 'auth', 'private_key', 'credentials', 'access_key', 'db_pwd', 'PWD'])}={quote(draw(mixed + '!#%', 10, 40))}"],
            lambda: [r.choice(["pwd", "passphrase", "credentials", "password"]), r.choice(["is", ":", "="]), quote(draw(mixed + "!#%$", 9, 20))],
            lambda: [f"{r.choice(['postgres', 'mysql', 'https', 'redis'])}://{draw(string.ascii_lowercase, 3, 8)}:{draw(mixed, 8, 24)}@{draw(string.ascii_lowercase, 3, 8)}.example.com/{draw(string.ascii_lowercase, 2, 6)}"],
            lambda: ["-----BEGIN", "RSA", "PRIVATE", "KEY-----", *(draw(mixed + "+/", 40, 64) for _ in range(r.randint(1, 4))), "-----END", "RSA", "PRIVATE", "KEY-----"],
            lambda: [draw(mixed, 32, 44)],
            lambda: [r.choice(["pwd", "passphrase", "credentials", "password"]), r.choice(["is", ":", "="]), quote("-".join(word() for _ in range(r.randint(3, 6))))],
            lambda: [r.choice(["pwd:", "passphrase:", "password:", "passwd:", "pwd="]), quote(r.choice(["-".join(word() for _ in range(r.randint(3, 6))), draw(string.ascii_lowercase, 16, 28)]))],
            lambda: [r.choice(["pwd", "passphrase", "password"]), r.choice(["is", ":", "="]), quote(draw(string.ascii_lowercase, 16, 28))],
            lambda: [*r.choice([["Bearer"], ["Authorization:", "Basic"], ["token", ":"], ["secret_key", "="]]), draw(string.ascii_letters, 20, 39) + r.choice(["", "=", "=="])],
        ])()
        if words[0].startswith("-----"):
            return words, [BEGIN] + [INSIDE] * (len(words) - 1)
        return words, [OUTSIDE] * (len(words) - 1) + [BEGIN]

    out = []
    for _ in range(count):
        words, tags = [], []
        for _ in range(r.randint(1, 3)):
            part = [prose() for _ in range(r.randint(0, 5))]
            words += part
            tags += [OUTSIDE] * len(part)
            found, tagged = secret() if r.random() < 0.45 else (decoy(), None)
            words += found
            tags += tagged or [OUTSIDE] * len(found)
        words.append(prose())
        tags.append(OUTSIDE)
        whole = file_features(" ".join(words))
        out.append([(features(words, t, whole), tags[t]) for t in range(len(words))])
    return out


@functools.cache
def trained() -> crf.Model:
    """The model, trained once in a driver's life; its bound is the number of sequences in examples()."""
    return crf.train(examples(), 3, penalty=0.001, steps=120, rate=1.5)


class Tagger:
    """Spans of secrets in a text by a trained model. Remembers which words are plain."""

    MEMO = 500_000

    def __init__(self, model: crf.Model) -> None:
        self.model = model
        self.plain, self.other, self.openers = set[str](), set[str](), set[str]()
        self.kinds: dict[tuple[str, ...], bool] = {}
        # the most that the transitions around a word can add to each tag against outside
        moves = np.vstack((model.moves, model.first))
        self.gain = np.array([(moves[:, k] - moves[:, OUTSIDE]).max() + max(0.0, (model.moves[k] - model.moves[OUTSIDE]).max()) for k in range(len(model.first))])

    def outside(self, names: tuple[str, ...]) -> bool:
        """Whether a word of these features is outside whatever its neighbours' tags are."""
        if names not in self.kinds:
            if len(self.kinds) > self.MEMO:
                self.kinds.clear()
            own = self.model.emission(names)
            self.kinds[names] = bool((own[OUTSIDE] - own[BEGIN:] > self.gain[BEGIN:]).all())
        return self.kinds[names]

    def is_plain(self, word: str) -> bool:
        """Whether a word is outside after any word that doesn't open, in a file without a block."""
        if not _LETTERS.fullmatch(word) or _FENCE.match(word) or unusual(word):
            return False
        return self.outside((*letters(word), "file block 0"))

    def doubts(self, words: list[str], whole: list[str]) -> list[bool]:
        """For each word of a text, whether it has to be decoded; an empty list where none has."""
        if whole[1] != "file block 0":
            return [True] * len(words)
        distinct = set(words)
        new = distinct - self.plain - self.other
        if len(self.plain) + len(self.other) + len(new) > self.MEMO:
            self.plain, self.other, self.openers, new = set(), set(), set(), distinct
        for w in new:
            (self.plain if self.is_plain(w) else self.other).add(w)
            if opens(w):
                self.openers.add(w)
        doubtful, openers = distinct & self.other, distinct & self.openers
        if not doubtful and not openers:
            return []
        out, after = [], False
        for t, w in enumerate(words):
            doubt = w in doubtful
            if (after or doubt) and (_LETTERS.fullmatch(w) and not _FENCE.match(w)):
                doubt = not self.outside(tuple(features(words, t, whole)))
            out.append(doubt)
            after = w in openers
        return out if any(out) else []

    def __call__(self, text: str) -> list[tuple[int, int]]:
        words, whole = text.split(), file_features(text)
        doubtful = self.doubts(words, whole)
        if not doubtful:
            return []
        spans, t = [], 0
        places = [m.start() for m in _WORDS.finditer(text)]
        while t < len(words):
            if not doubtful[t]:
                t += 1
                continue
            end = t
            while end < len(words) and doubtful[end]:
                end += 1
            emissions = np.array([self.model.emission(features(words, i, whole)) for i in range(t, end)])
            tags = self.model.decode(emissions, OUTSIDE if t else None, OUTSIDE if end < len(words) else None)
            for i, tag in enumerate(tags, t):
                a, b = core(words[i]) if tag == BEGIN and not _FENCE.match(words[i]) else (0, len(words[i]))
                if tag == BEGIN and b > a:
                    spans.append((places[i] + a, places[i] + b))
                elif tag == INSIDE and spans and i > t and tags[i - 1 - t] != OUTSIDE:
                    spans[-1] = (spans[-1][0], places[i] + b)
            t = end
        return spans


def scanner():
    """(base, added) spans of a text, by the trained model."""
    model = trained()
    held: dict[str, Tagger] = {}

    def scan(text: str) -> tuple[list[S.Span], list[S.Span]]:
        if "tagger" not in held:
            held["tagger"] = Tagger(model)
        found = base(text)
        return found, S.apart([(TAGGED, a, b) for a, b in held["tagger"](text)], found)

    return scan


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, added) for docs(doc_id, text): spans in code points, end exclusive.

    A null or empty text has none; repeated rows and null ids are kept, one result row
    each; further columns are not read.
    """
    return S.scan(docs, scanner(), KINDS)


def mask(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with secrets replaced by their kind; nulls, repeated rows and further columns as in find()."""
    return S.masked(docs, scanner(), KINDS)


def summary(docs: DataFrame) -> DataFrame:
    """One row per document with counts and digest of the base spans and all spans as text."""
    return S.summary(docs, scanner(), KINDS, KINDS[:3])
