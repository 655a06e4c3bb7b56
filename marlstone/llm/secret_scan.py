"""Secret scans by a linear-chain conditional random field.

Tokens are tagged O (outside), B (begins a secret) or I (inside one). Features of a token are its shape, length, alphabet, entropy
and, for the words of a short list, the word; of its neighbours from three before to one after, the same; and of the file, whether it
holds such words and how dense its symbols are. Weights are fitted by maximum likelihood, the gradient coming from the
forward-backward recursions; tags are decoded by Viterbi.

There are no labelled secrets, so the training text is made: windows of a bounded sample of documents, cut from the stretches
between candidates, into which secrets of public formats, drawn at random, are written. Sentences of our own (`CARRIER`) stand in
where a sample has too few such stretches, so there always is a model. What a candidate is isn't known, so none is trained on; hashes,
ids and the like that are no secret are made, as secrets are.

Decoding visits few tokens one by one. Where O leads the other tags by more than transitions can
return to them, every best path has O there; Viterbi runs over the stretches between, from O to O.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the sample that training windows are cut from, in documents.
MAX_DOCS = 700
#: Windows come from so many stretches of text at least, of so many words; carrier text makes up what the sample lacks.
LEAST_STRETCHES, LEAST_WORDS = 100, 4
CARRIER = (
    "The meeting was moved to the second week of the month, and everyone who had signed up was told by letter.",
    "Please read the notes below before you change anything; most of the settings are shared by several services.",
    "def load(path): return open(path).read() if path else None # the caller closes nothing",
    "for item in items: total = total + item.price * item.count; print(total)",
    "server { listen: port; host: example; timeout: 30; retries: 3 } # default section of the file",
    "INFO worker started, queue empty, waiting for jobs; WARN disk is nearly full; INFO worker stopped",
    "SELECT name, count(*) FROM orders JOIN customers USING (id) WHERE total > 100 GROUP BY name",
    '{"name": "sample", "size": 12, "tags": ["a", "b"], "active": true, "parent": null}',
    "<div class=\"row\"><a href=\"/about\">About us</a> <p>Opening hours: 9 to 17</p></div>",
    "Le rapport de la commission sera rendu public avant la fin de l'année, selon le ministre.",
    "Die Sitzung beginnt um neun Uhr und endet, sobald alle Punkte der Liste besprochen sind.",
    "El informe anual se publica en marzo y contiene los datos de todas las regiones del país.",
)
SEED = 5
WORD, VALUE = re.compile(r"\S*"), re.compile(r"\s*\S*")
TOKEN = re.compile(r"[\w+/-]+|[^\w\s]")
OFFSETS = (-3, -2, -1, 0, 1)
KEYWORDS = frozenset("password passwd pwd pass secret token key apikey api_key api-key access_key secret_key auth authorization bearer credential credentials private client_secret aws login".split())
O, B, I = 0, 1, 2
_HEX, _UPPER, _SYMBOL = frozenset("0123456789abcdefABCDEF"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), frozenset("=:\"'{}<>[]")


def token_features(token: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    n = len(token)
    size = "size=" + (str(n) if n < 4 else "4-7" if n < 8 else "8-15" if n < 16 else "16-23" if n < 24 else "24-39" if n < 40 else "40+")
    low = token.lower()
    if low in KEYWORDS:
        return ("word=" + low, "keyword")
    if token.isalpha():
        case = "lower" if token.islower() else "upper" if token.isupper() else "title" if token[1:].islower() else "mixed"
        return (size, "alpha=" + case, f"alpha={case},{size}")
    if n == 1:
        return ("digit" if token.isdigit() else "symbol=" + token if token in _SYMBOL else "symbol",)
    digits = sum(c.isdigit() for c in token)
    if digits == n:
        return (size, "digits", "digits," + size)
    shape = re.sub(r"(.)\1+", r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in token))
    alphabet = "hex" if _HEX.issuperset(token) else "upper" if _UPPER.issuperset(token) else "other"
    counts = Counter(token)
    entropy = -sum(k / n * log2(k / n) for k in counts.values())
    changes = len(shape)
    return (
        size,
        "alphabet=" + alphabet,
        f"alphabet={alphabet},{size}",
        "shape=" + (shape if changes < 5 else "long"),
        f"entropy={int(entropy * 2)}",
        f"entropy={int(entropy * 2)},{size}",
        f"digits={int(4 * digits / n)}",
        f"turns={min(changes // 3, 5)}",
        "head=" + re.sub(r"\d", "0", token[:4]),
        "symbols" if "-" in shape else "plain",
    )


def file_features(tokens: list[str]) -> tuple[str, ...]:
    """Features of the whole file: whether it holds key words, and the share of symbols among its tokens."""
    symbols = sum(map(_SYMBOL.__contains__, tokens)) / max(len(tokens), 1)
    return ("file:keyword" if any(t.lower() in KEYWORDS for t in set(tokens)) else "file:none", f"file:symbols={min(int(symbols * 20), 4)}")


def _make(rng: random.Random) -> tuple[str, str, str]:
    """Text before a made secret, the secret, and text after it."""

    def draw(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    low, up, dec = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    any_, hex_ = low + up + dec, "0123456789abcdef"
    kind = rng.randrange(9)
    word = rng.choice(["password", "passwd", "token", "secret", "api_key", "apikey", "key", "auth", "pwd", "access_key", "client_secret"])
    word = rng.choice([word, word, word.upper(), word.title()])
    assign = rng.choice(["=", "=", " = ", ": ", ":", " "])
    quote = rng.choice(['"', '"', "'", "", ""])
    if kind == 0:
        return "", rng.choice(["AKIA", "ASIA"]) + draw(up + dec, 16), ""
    if kind in (1, 2):
        return word + assign + quote, draw(hex_, rng.choice([12, 16, 18, 20, 24, 32, 40, 64])), quote
    if kind == 3:
        return word + assign + quote, draw(any_, rng.randrange(10, 44)), quote
    if kind == 4:
        return rng.choice(["", word + assign + quote]), rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "hf_"]) + draw(any_, rng.choice([24, 32, 36, 40])), ""
    if kind == 5:
        return rng.choice(["", "Bearer ", "Authorization: Bearer "]), "eyJ" + draw(any_, 30) + ".eyJ" + draw(any_, 40) + "." + draw(any_ + "-_", 43), ""
    if kind == 6:
        return rng.choice(["", word + assign]), "xox" + rng.choice("bpa") + "-" + draw(dec, 11) + "-" + draw(dec, 12) + "-" + draw(any_, 24), ""
    if kind == 7:
        return word + assign + quote, draw(any_ + "+/", 40), quote
    return word + assign + quote, draw(low + dec, 6) + rng.choice("!@#$%") + draw(any_, 5), quote


def _identifiers(rng: random.Random) -> list[str]:
    """Made text that holds long mixed tokens and no secret: a hash, an id, the address of a page, a file name."""
    draw = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return [
        f"{rng.choice(['commit', 'revision', 'tree', 'sha1', 'sha256', 'md5'])} {draw(rng.choice([7, 12, 32, 40, 64]))}",
        f"{rng.choice(['id', 'uuid', 'request', 'session'])} {draw(8)}-{draw(4)}-4{draw(3)}-a{draw(3)}-{draw(12)}",
        f"https://www.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['item', 'watch', 'p', 'articles'])}/{draw(rng.randrange(8, 24))}{rng.choice(['', '.html', '?page=2', '/index.php'])}",
        f"{rng.choice(['IMG', 'report', 'build', 'part'])}_{rng.randrange(2000, 2030)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}_{draw(6)}.{rng.choice(['jpg', 'pdf', 'log', 'parquet'])}",
    ]


CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{10,}|" + "|".join(rf"\b{k}\b\s*[=:]" for k in sorted(KEYWORDS)), re.IGNORECASE)


def stretches(texts: list[str]) -> list[str]:
    """The parts of texts before, between and after candidates, with the word of a candidate left out; carrier text where they are few.

    A text without a candidate is one part, the whole. Parts of other texts are of LEAST_WORDS words or more.
    """
    out = []
    for text in texts:
        at, parts = 0, []
        for found in CANDIDATE.finditer(text):
            if found.start() < at:
                continue
            head = text[at : found.start()]
            parts.append(head[: -len(head.split()[-1])] if head and not head[-1].isspace() else head)
            # a key word's value, even after a space or in quotes, goes with it
            at = (VALUE if found[0][-1] in "=:" else WORD).match(text, found.end()).end()
        out += [x for x in (*parts, text[at:]) if len(x.split()) >= LEAST_WORDS] if parts else [text]
    return out + [CARRIER[i % len(CARRIER)] for i in range(LEAST_STRETCHES - len(out))]


def training_windows(texts: list[str], seed: int = SEED) -> list[tuple[list[str], list[int], tuple[str, ...]]]:
    """(tokens, tags, file features) of windows of 40 tokens; two of three have a made secret."""
    rng, out = random.Random(seed), []
    for text in stretches(texts):
        words = text.split()
        for _ in range(3):
            at = rng.randrange(max(1, len(words)))
            left, right = " ".join(words[max(0, at - 15) : at]), " ".join(words[at : at + 15])
            kind = rng.randrange(6)
            if kind < 4:
                before, secret, after = _make(rng)
                join = lambda x, y: f"{x} {y}" if x and y else x + y
                head = TOKEN.findall(join(left, before))
                middle, tail = TOKEN.findall(secret), TOKEN.findall(join(after, right) if after != '"' and after != "'" else after + " " + right)
                tags = [O] * len(head) + [B] + [I] * (len(middle) - 1) + [O] * len(tail)
                tokens = head + middle + tail
            elif kind == 4:  # what looks like secrets and isn't: plain numbers, dates, addresses, key words in prose
                plain = rng.choice([f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", ".".join(str(rng.randrange(256)) for _ in range(4)), *[f"{rng.choice(words or ['a']).lower()}{rng.choice(['', '.', '_', '-'])}{rng.choice(['', '7', '42', '08', '1984'])}@{rng.choice(['mail', 'post', 'web', rng.choice(words or ['b'])])}{rng.choice(['', '3', '12'])}.{rng.choice(['com', 'org', 'example.com', 'net'])}" for _ in range(4)], f"https://www.{rng.choice(words or ['c'])}.org/{rng.choice(words or ['d'])}/{rng.randrange(10**6)}", f"DE{rng.randrange(10**20):020d}", " ".join(str(rng.randrange(1000, 9999)) for _ in range(4)), f"the {rng.choice(sorted(KEYWORDS))} {rng.choice(words or ['e'])}", f"{rng.choice(['v', 'version', 'x', 'no'])}{rng.randrange(100)}", rng.choice(words or ["f"]) * 6, *_identifiers(rng)])
                tokens = TOKEN.findall(f"{left} {plain} {right}")
                tags = [O] * len(tokens)
            else:
                tokens = TOKEN.findall(f"{left} {right}")
                tags = [O] * len(tokens)
            if tokens:
                out.append((tokens, tags, file_features(tokens)))
    return out


def _padded(tokens: list[str]) -> list[str | None]:
    return [None] * 3 + tokens + [None]


def _active(tokens: list[str], t: int, file: tuple[str, ...], features) -> list[str]:
    row = _padded(tokens)
    return [f"{o}:{x}" for o in OFFSETS for x in (features(row[t + 3 + o]) if row[t + 3 + o] is not None else ("edge",))] + list(file)


def fit(texts: list[str], seed: int = SEED, rounds: int = 60, penalty: float = 1.0) -> dict | None:
    """Weights of the field: unary {feature: 3 numbers}, transitions 3 x 3, starts 3."""
    windows = training_windows(texts, seed)
    if not any(B in tags for _, tags, _ in windows):
        return None
    cache: dict[str, tuple[str, ...]] = {}

    def features(token: str) -> tuple[str, ...]:
        found = cache.get(token)
        if found is None:
            found = cache[token] = token_features(token)
        return found

    seen = Counter(x for tokens, _, file in windows for t in range(len(tokens)) for x in _active(tokens, t, file, features))
    number = {x: k for k, x in enumerate(sorted(x for x, n in seen.items() if n >= 3))}
    width, count = max(len(w[0]) for w in windows), len(windows)
    tags = np.zeros((count, width), np.int64)
    mask = np.zeros((count, width), bool)
    rows, cols = [], []
    for s, (tokens, own, file) in enumerate(windows):
        tags[s, : len(own)] = own
        mask[s, : len(own)] = True
        for t in range(len(tokens)):
            for x in _active(tokens, t, file, features):
                k = number.get(x)
                if k is not None:
                    rows.append(s * width + t)
                    cols.append(k)
    rows, cols = np.array(rows), np.array(cols)
    onehot = np.eye(3)[tags] * mask[:, :, None]
    w, trans, start = np.zeros((len(number), 3)), np.zeros((3, 3)), np.zeros(3)
    gold = np.stack([np.bincount(cols, onehot.reshape(-1, 3)[rows, c], len(number)) for c in range(3)], 1)
    both = mask[:, 1:] & mask[:, :-1]
    gold_trans = np.einsum("sti,stj->ij", onehot[:, :-1] * both[:, :, None], onehot[:, 1:])
    gold_start = onehot[:, 0].sum(0)
    moments = [np.zeros_like(x) for x in (w, trans, start)] + [np.zeros_like(x) for x in (w, trans, start)]
    size = count * width
    for step in range(1, rounds + 1):
        emit = np.stack([np.bincount(rows, w[cols, c], size) for c in range(3)], 1).reshape(count, width, 3)
        alpha, beta = np.zeros((count, width, 3)), np.zeros((count, width, 3))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, width):
            a = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            b = np.logaddexp.reduce(trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], b, 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + trans + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        flat = p.reshape(-1, 3)
        grads = (
            gold - np.stack([np.bincount(cols, flat[rows, c], len(number)) for c in range(3)], 1) - penalty * w,
            gold_trans - pair.sum((0, 1)) - penalty * trans,
            gold_start - p[:, 0].sum(0) - penalty * start,
        )
        for k, (x, g) in enumerate(zip((w, trans, start), grads, strict=True)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 3] = 0.99 * moments[k + 3] + 0.01 * g * g
            x += 0.15 * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 3] / (1 - 0.99**step)) + 1e-8)
    return {"unary": {x: w[k].tolist() for x, k in number.items()}, "trans": trans.tolist(), "start": start.tolist()}


class Tagger:
    """Decodes texts with fitted weights."""

    def __init__(self, model: dict, most: int = 500_000) -> None:
        self.unary, self.most = model["unary"], most
        self.trans, self.start = np.array(model["trans"]), np.array(model["start"])
        t = self.trans
        self.reach = max(t[a, x] + t[x, c] - t[a, O] - t[O, c] for a in range(3) for x in (B, I) for c in range(3))
        self.reach = max(self.reach, *(t[a, x] - t[a, O] for a in range(3) for x in (B, I)), *(self.start[x] + t[x, c] - self.start[O] - t[O, c] for x in (B, I) for c in range(3)), *(self.start[x] - self.start[O] for x in (B, I)))
        self.kinds: dict[tuple[str, ...], int] = {}
        self.parts: list[np.ndarray] = []
        self.known: dict[str, int] = {}
        self.edge = self._kind(("edge",))
        self.table = np.zeros((0, len(OFFSETS), 3))

    def _kind(self, features: tuple[str, ...]) -> int:
        k = self.kinds.get(features)
        if k is None:
            k = self.kinds[features] = len(self.parts)
            nothing = [0.0] * 3
            self.parts.append(np.array([np.sum([self.unary.get(f"{o}:{x}", nothing) for x in features], axis=0) for o in OFFSETS]))
        return k

    def _kinds(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, tokens))
        if None in out:
            if len(known) > self.most:
                known.clear()
            for k, t in enumerate(out):
                if t is None:
                    t = known.get(tokens[k])
                    if t is None:
                        t = known[tokens[k]] = self._kind(token_features(tokens[k]))
                    out[k] = t
        return np.array(out, np.int64)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        kinds = np.concatenate((np.full(3, self.edge), self._kinds(tokens), [self.edge]))
        if len(self.table) < len(self.parts):
            self.table = np.array(self.parts)
        n = len(tokens)
        out = np.zeros((n, 3))
        for k, o in enumerate(OFFSETS):
            out += self.table[kinds[3 + o : 3 + o + n], k]
        nothing = [0.0] * 3
        for x in file_features(tokens):
            out += np.array(self.unary.get(x, nothing))
        return out

    def viterbi(self, emit: np.ndarray, before: int | None, after: int | None) -> list[int]:
        """The best tags of a stretch, given the tags beside it (None: the end of the text)."""
        score = emit[0] + (self.start if before is None else self.trans[before])
        back = []
        for e in emit[1:]:
            each = score[:, None] + self.trans
            back.append(each.argmax(0))
            score = each.max(0) + e
        if after is not None:
            score = score + self.trans[:, after]
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tags(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        if not tokens:
            return out
        emit = self.emissions(tokens)
        open_ = np.flatnonzero(emit[:, O] - np.maximum(emit[:, B], emit[:, I]) <= self.reach)
        if len(open_):
            for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                a, b = int(part[0]), int(part[-1]) + 1
                out[a:b] = self.viterbi(emit[a:b], None if a == 0 else O, None if b == len(tokens) else O)
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character ranges of the secrets of a text."""
        tokens = TOKEN.findall(text)
        tags = self.tags(tokens)
        if not tags.any():
            return []
        out: list[list[int]] = []
        last = O
        for found, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
            if tag == B or tag == I and last == O:
                out.append([found.start(), found.end()])
            elif tag == I:
                out[-1][1] = found.end()
            last = tag
        return [(a, b) for a, b in out]


def sample_texts(docs: DataFrame, max_docs: int = MAX_DOCS) -> list[str]:
    """A bounded sample of whole texts, in the order of the MD5 of their ids."""
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("k")).orderBy("k").limit(max_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most max_docs ids
    return [r.text for r in sorted(texts.collect(), key=lambda r: (r.k, r.text))][:max_docs]


def scan(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, start, end, masked): a row for each secret, its range in characters from 0, and its first four characters.

    Whole texts are tagged. Null and empty texts have no secrets; without a model nothing has. Repeated
    rows and null ids give their own rows. Other columns are ignored.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model) if model else None
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text and tagger:
                    rows += [(key, a, b, text[a : min(a + 4, b)] + "***") for a, b in tagger.spans(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "masked"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(work, "doc_id string, start int, end int, masked string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def find_secrets(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """scan() with a model fitted on a bounded sample of docs."""
    return scan(docs, fit(sample_texts(docs, max_docs)))
