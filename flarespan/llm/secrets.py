"""Secret scans: fixed patterns plus a small character convolutional network over every candidate.

Candidates are all long runs of key-like characters, whatever they hold, that are not just one word
in letters (with punctuation around it); of a run that holds base findings, the rest is looked at.
The network (numpy; embedding, convolution, maximum over places, dense) sees a whole candidate and
the text before and after it in overlapping windows, in which the candidate's characters are
marked; the highest score counts.

Labelled findings come from the corpus: base findings are secrets; so are made-up secrets of several
kinds, set into places of the texts, and made-up look-alikes (addresses, dates, paths, names) set
into other places are not.  The corpus's other candidates are taken as no secrets: a secret among
them makes the network careful, but the threshold is bound by recall on known ones.  All different
windows of all documents are learnt from, but for a quarter by hash: they are dealt into blocks by
hash, and in each round every block trains the network on its own windows from the same parameters,
whose mean over the blocks is the start of the next round.  Scores are calibrated on all held-back
windows (a logistic fit), and the threshold is the largest one that keeps the wanted recall on all
held-back secrets of either class; both need only the counts of the scores, which lie on a grid.  Base findings always stay; the network adds spans.

A null or empty text has no findings.  Long texts are read whole.  Equal texts and repeated rows have
equal findings.  Without anything to learn from nothing is added.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
import string
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_texts, small_batches, stored

#: The base patterns, in the order of their kinds, with the least length of what counts.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")  # runs are whole, so this finds the same as HEX with 16 or more
KINDS = ("assign", "access", "hex", "net")

LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.@~!#$%^&*:-]{{{LEAST},}}")
#: One word in letters, with or without punctuation around it.
WORD = re.compile(r"[^A-Za-z0-9]*(?:[A-Z]?[a-z]+|[A-Z]+)[^A-Za-z0-9]*")
#: Characters of context on either side, of a window, and between the starts of windows.
CONTEXT, WINDOW, STRIDE = 24, 64, 32
EMBED, WIDE, FILTERS = 8, 5, 16
#: Windows of each of the four classes in a quarter of a block's rows; rounds of training with one block; recall that is kept.
MOST_EACH, EPOCHS, RECALL = 2_500, 8, 0.95
#: Windows in a block, and rounds of training with many blocks: each window is used in each round.
BLOCK, ROUNDS = 16 * MOST_EACH, 3
BATCH = 512
#: Logits are rounded down to this grid and bounded; parameters are summed as whole numbers of this size, so that the order does not matter.
GRID, REACH, UNIT = 1 / 1024, 35, 2.0**-24
#: Parameters that are trained.
TRAINED = ("E", "W", "c", "v", "d")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def other_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates, and what base findings leave of them."""
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        lo, end = m.span()
        while at and base[at - 1][2] > lo:
            at -= 1
        while at < len(base) and base[at][0] < end:
            if base[at][2] > lo:
                out.append((lo, base[at][0]))
                lo = base[at][2]
            at += 1
        out.append((lo, end))
    return [(s, e) for s, e in out if e - s >= LEAST and not WORD.fullmatch(text, s, e)]


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Character codes of a candidate and its context: printable ASCII as 1 to 95, others 96, none 0; 96 more inside the candidate."""
    lo, hi = start - CONTEXT, end + CONTEXT
    part = np.frombuffer(text[max(0, lo) : hi].encode("utf-32-le"), "<u4").astype(np.int64) - 31
    part[(part < 1) | (part > 95)] = 96
    count = 1 + max(0, -(-(hi - lo - WINDOW) // STRIDE))
    codes = np.zeros(WINDOW + (count - 1) * STRIDE, np.uint8)
    codes[max(0, -lo) : max(0, -lo) + len(part)] = part
    codes[CONTEXT : CONTEXT + end - start] += 96
    return [codes[k * STRIDE : k * STRIDE + WINDOW].tobytes() for k in range(count)]


_ALNUM, _URL = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"


def made_up(rng: random.Random, kind: int) -> str:
    """A made-up secret of one of the SECRETS kinds: signed token, key in base64, prefixed keys, upper-case hex, password."""
    some = lambda chars, lo, hi: "".join(rng.choices(chars, k=rng.randint(lo, hi)))
    match kind:
        case 0:
            return f"eyJ{some(_URL, 15, 40)}.{some(_URL, 30, 90)}.{some(_URL, 30, 43)}"
        case 1:
            return some(_ALNUM + "+/", 30, 88) + "=" * rng.randint(0, 2)
        case 2:
            return rng.choice(["ghp_", "gho_", "glpat-", "npm_"]) + some(_ALNUM, 20, 36)
        case 3:
            return rng.choice(["sk_live_", "pk_test_", "rk_live_", "key-"]) + some(_ALNUM, 16, 32)
        case 4:
            return f"xox{rng.choice('bpa')}-{some(string.digits, 10, 12)}-{some(_ALNUM, 18, 28)}"
        case 5:
            return some("0123456789ABCDEF", 24, 64)
        case 6:
            return some(_ALNUM, 16, 48)
        case _:
            return some(_ALNUM + "!#$%^&*-_", 12, 20) + rng.choice("!#$%^&*") + some(_ALNUM, 2, 6)


def look_alike(rng: random.Random) -> str:
    """A made-up harmless string: address, number, date, path, name, version, identifier."""
    word = lambda lo=3, hi=10: "".join(rng.choices(string.ascii_lowercase, weights=[8, 2, 3, 4, 12, 2, 2, 5, 7, 1, 1, 4, 3, 7, 8, 2, 1, 6, 6, 9, 3, 1, 2, 1, 2, 1], k=rng.randint(lo, hi)))
    digits = lambda lo, hi: "".join(rng.choices(string.digits, k=rng.randint(lo, hi)))
    match rng.randrange(12):
        case 0:
            return ".".join(str(rng.randrange(100, 256)) for _ in range(4)) + rng.choice(["", "", f":{rng.randrange(1000, 65536)}", "."])
        case 1:
            return f"{word()}{rng.choice(['', '.' + word(), digits(1, 4)])}@{word()}.{rng.choice(['com', 'org', 'net', 'de', 'example'])}{rng.choice(['', '.', ':'])}"
        case 2:
            return f"{rng.choice(['http', 'https'])}://{word()}.{rng.choice(['com', 'org', 'net'])}/" + "/".join(word() for _ in range(rng.randint(1, 3)))
        case 3:
            return digits(12, 19)
        case 4:
            return f"{rng.randrange(1970, 2040)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"
        case 5:
            return "/" + "/".join(word() for _ in range(rng.randint(2, 4))) + rng.choice(["", ".py", ".txt", ".html"])
        case 6:
            return "-".join(word() for _ in range(rng.randint(3, 5)))
        case 7:
            return word() + "".join(word().capitalize() for _ in range(rng.randint(2, 4)))
        case 8:
            return "_".join(word() for _ in range(rng.randint(3, 5)))
        case 9:
            return f"{word(5, 9)}-{rng.randrange(20)}.{rng.randrange(30)}.{rng.randrange(30)}{rng.choice(['', '-beta', '.tar.gz'])}"
        case 10:
            return rng.choice("*=-_#~.") * rng.randint(LEAST, 40)
        case _:
            return f"{word(6, 10)}{rng.choice(['$$$', '***', '%%%', '&&&', '###', '!!!'])}{word(6, 10)}{rng.choice('.:!')}"


SECRETS = 8


def labelled(text: str, kinds: tuple[int, ...] = tuple(range(SECRETS))) -> list[tuple[bytes, int, int]]:
    """(window, found, class) of a text: its base findings (1, 0), its other candidates (0, 1), a made-up secret (1, 2) and look-alike (0, 3) set into it."""
    base = base_spans(text)
    out = [(w, 1, 0) for s, _, e in base for w in windows(text, s, e)]
    out += [(w, 0, 1) for s, e in other_candidates(text, base) for w in windows(text, s, e)]
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    for found, made in ((1, made_up(rng, rng.choice(kinds))), (0, look_alike(rng))):
        at = rng.randrange(len(text) + 1)
        at = text.find(" ", at) + 1 or len(text)
        near = text[max(0, at - 2 * CONTEXT) : at]
        lead = rng.choice(["", "", "key ", "pwd: ", "login ", "auth=", "id: ", "("]) if found else rng.choice(["", "", "id: ", "see ", "at ", "(", "no. "])
        other = look_alike(rng) if found else made_up(rng, rng.choice(kinds))  # one of the other sort may stand close by
        before, after = rng.choice([("", ""), ("", ""), (f"{other} ", ""), ("", f"{other} ")])
        made_text = f"{near}{before}{lead}{made} {after}{text[at : at + 2 * CONTEXT]}"
        lo = len(near) + len(before) + len(lead)
        out += [(w, found, 2 if found else 3) for w in windows(made_text, lo, lo + len(made))]
    return out


class Net:
    """Parameters: embedding E, filters W and c, output v and d; Platt slope and level; threshold."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "E": rng.normal(0, 0.5, (193, EMBED)), "W": rng.normal(0, (2 / (WIDE * EMBED)) ** 0.5, (WIDE * EMBED, FILTERS)), "c": np.zeros(FILTERS),
            "v": rng.normal(0, 0.3, FILTERS), "d": np.zeros(1), "platt": np.array([1.0, 0.0]), "limit": np.array([2.0]),
        }
        self.p |= {k: self.p[k].astype(np.float32) for k in TRAINED}

    def forward(self, x: np.ndarray):
        e = self.p["E"][x].reshape(len(x), WINDOW * EMBED)
        # the inputs of a place are WIDE embeddings in a row
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDE * EMBED, axis=1)[:, ::EMBED]
        act = cols.reshape(-1, WIDE * EMBED) @ self.p["W"]
        act = act.reshape(len(x), WINDOW - WIDE + 1, FILTERS) + self.p["c"]
        best = act.argmax(1)
        top = np.maximum(np.take_along_axis(act, best[:, None], 1)[:, 0], 0)
        return top @ self.p["v"] + self.p["d"][0], (cols, best, top)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Logits on the grid, as whole numbers of steps."""
        z = np.concatenate([self.forward(x[i : i + BATCH])[0] for i in range(0, len(x), BATCH)]) if len(x) else np.empty(0)
        return np.floor(np.clip(z.astype(float), -REACH, REACH) / GRID).astype(np.int64)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(self.p[k]) for k in TRAINED}
        s = {k: np.zeros_like(self.p[k]) for k in TRAINED}
        step, y = 0, y.astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 64):
                at = order[lo : lo + 64]
                z, (cols, best, top) = self.forward(x[at])
                dz = (1 / (1 + np.exp(-np.clip(z, -REACH, REACH))) - y[at]) / np.float32(len(at))
                dtop = dz[:, None] * self.p["v"] * (top > 0)
                rows = np.arange(len(at))[:, None]
                picked = cols[rows, best]  # example, filter, inputs
                g = {"v": top.T @ dz, "d": dz.sum(keepdims=True), "c": dtop.sum(0), "W": np.einsum("nfi,nf->if", picked, dtop)}
                dcol = dtop[:, :, None] * self.p["W"].T[None]
                places = x[at][rows[:, :, None], best[:, :, None] + np.arange(WIDE)].ravel().astype(np.int64)
                places = (places[:, None] * EMBED + np.arange(EMBED)).ravel()
                g["E"] = np.bincount(places, dcol.ravel(), self.p["E"].size).reshape(self.p["E"].shape).astype(np.float32)
                step += 1
                for k in TRAINED:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, group: np.ndarray, n: np.ndarray) -> None:
        """Logistic fit of label on logit, then the largest threshold with the wanted recall in each group that has secrets.

        ``n`` is the number of windows that have the logit (in steps of the grid), label and group.
        """
        if not y.any() or y.all():
            return
        a, b, w, u = 1.0, 0.0, n / n.sum(), z * GRID
        for _ in range(200):
            e = w * (1 / (1 + np.exp(-np.clip(a * u + b, -REACH, REACH))) - y)
            a -= 0.1 * float(e @ u) / (1 + float(w @ (u * u)))
            b -= 0.1 * float(e.sum())
        self.p["platt"] = np.array([a, b])
        p, limits = self.calibrated(z), []
        for k in np.unique(group[y > 0]):
            at = np.flatnonzero((y > 0) & (group == k))
            at = at[np.argsort(p[at], kind="stable")]
            upto = np.cumsum(n[at])
            limits.append(p[at][np.searchsorted(upto, int((1 - RECALL) * upto[-1]), "right")])
        self.p["limit"] = np.array([min(limits)])

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        a, b = self.p["platt"]
        return 1 / (1 + np.exp(-np.clip(a * (z * GRID) + b, -REACH, REACH)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Net:
        net = cls()
        with np.load(io.BytesIO(data)) as f:
            net.p = {k: f[k] for k in f.files}
        return net


def labelled_windows(docs: DataFrame) -> DataFrame:
    """window, found (1: a secret), class: every different window of each class over all documents."""

    def run(raw):
        rows = sorted({r for x in raw if x for r in labelled(x.decode("utf-8", "replace"))})
        return {"_row": np.zeros(len(rows), np.int64), "window": [r[0] for r in rows], "found": [r[1] for r in rows], "class": [r[2] for r in rows]}

    return map_texts(docs.select("text"), run, {"window": "binary", "found": "int", "class": "int"}, ()).distinct()


def held_back(window: bytes) -> bool:
    """Whether a window is for calibration, by hash: a quarter is."""
    return hashlib.blake2b(window, digest_size=1).digest()[0] % 4 == 0


def arrays(rows: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes, found and class of (window, found, class)."""
    return np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, WINDOW), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)


def counted(net: Net, x: np.ndarray, y: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (logit in steps, found, class) as columns, and how often each is there."""
    return np.unique(np.stack([net.logits(x), y, group]), axis=1, return_counts=True)


def fitted(rows: list[tuple[bytes, int, int]]) -> Net:
    """What ``fit`` does, with one block's rows in memory: trained on three quarters of the (window, found, class), by hash, calibrated on the rest."""
    net, rows = Net(), sorted(set(rows))
    if rows:
        (x, y, group), held = arrays(rows), np.array([held_back(r[0]) for r in rows])
        net.train(x[~held], y[~held])
        (z, y, group), n = counted(net, x[held], y[held], group[held])
        net.calibrate(z, y, group, n)
    return net


def in_blocks(windows: DataFrame) -> tuple[DataFrame, int]:
    """The windows dealt by hash into blocks of about BLOCK, a row for each block and use (``held``), and the number of blocks."""
    every = stored(windows, "windows")
    blocks = max(1, -(-every.count() // BLOCK))
    rows = every.groupBy(F.pmod(F.xxhash64("window"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("window", "found", "class")).alias("rows"))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(len(b)):
                found = sorted((r["window"], r["found"], r["class"]) for r in b.column(1)[i].as_py())
                for held in (False, True):
                    part = [r for r in found if held_back(r[0]) == held]
                    values = [b.column(0)[i].as_py(), held, b"".join(r[0] for r in part), bytes(r[1] for r in part), bytes(r[2] for r in part)]
                    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["block", "held", "windows", "found", "class"])

    small_batches(windows.sparkSession)
    packed = stored(rows.mapInArrow(pack, "block long, held boolean, windows binary, found binary, class binary"), "blocks")
    forget(every)
    return packed.repartition(blocks, "block"), blocks


def unpacked(batch):
    """Block, character codes, found and class of each row."""
    for i in range(len(batch)):
        block, windows, found, group = (batch.column(k)[i].as_py() for k in (0, 2, 3, 4))
        yield block, np.frombuffer(windows, np.uint8).reshape(-1, WINDOW), np.frombuffer(found, np.uint8).astype(np.int64), np.frombuffer(group, np.uint8).astype(np.int64)


def trained_once(blocks: DataFrame, net: Net, number: int) -> Net:
    """The mean of what the blocks make of the network in one pass over their windows, by their number of windows; a sum comes back from each task."""
    data = net.dump()

    def task(batches):
        import pyarrow as pa

        total, rows = 0, 0
        for batch in batches:
            for block, x, y, _ in unpacked(batch):
                own = Net.load(data)
                own.train(x, y, seed=1_000 * block + number, epochs=1)
                total = total + len(x) * np.rint(np.concatenate([own.p[k].ravel() for k in TRAINED]) / UNIT).astype(np.int64)
                rows += len(x)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "total"])

    got = blocks.where("NOT held").mapInArrow(task, "n long, total array<long>").collect()
    out, n, at = Net.load(data), sum(r.n for r in got), 0
    if n:
        mean = sum(np.array(r.total) for r in got) / n * UNIT
        for k in TRAINED:
            size = out.p[k].size
            out.p[k], at = mean[at : at + size].reshape(out.p[k].shape).astype(np.float32), at + size
    return out


def held_counts(blocks: DataFrame, net: Net) -> list:
    """(z, found, class, n) of all held-back windows: as many rows as the grid has steps at most."""
    data = net.dump()

    def task(batches):
        import pyarrow as pa

        own = Net.load(data)
        for batch in batches:
            for _, x, y, group in unpacked(batch):
                keys, n = counted(own, x, y, group)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (*keys, n)], ["z", "found", "class", "n"])

    return blocks.where("held").mapInArrow(task, "z long, found long, class long, n long").groupBy("z", "found", "class").agg(F.sum("n").alias("n")).collect()


def fit(docs: DataFrame) -> bytes:
    """The network, a few KB, trained and calibrated on every labelled window of all documents."""
    blocks, many = in_blocks(labelled_windows(docs))
    blocks, net = stored(blocks, "dealt"), Net()
    for number in range(max(ROUNDS, EPOCHS // many)):
        net = trained_once(blocks, net, number)
    counts = sorted(tuple(r) for r in held_counts(blocks, net))
    if counts:
        net.calibrate(*np.array(counts, np.int64).T)
    forget(blocks)
    return net.dump()


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_candidates(net: Net, texts: list[str], base: list) -> list[tuple[int, int, int]]:
    """(text, start, end) of the candidates with a window that reaches the threshold."""
    found, owner, codes = [], [], []

    def look():
        x = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WINDOW)
        found.extend(sorted({o for o, hit in zip(owner, net.probability(x) >= net.p["limit"][0], strict=True) if hit}))
        owner.clear()
        codes.clear()

    for i, t in enumerate(texts):
        for s, e in other_candidates(t, base[i]):
            for w in windows(t, s, e):
                owner.append((i, s, e))
                codes.append(w)
                if len(codes) >= 8 * BATCH:
                    look()
    if codes:
        look()
    return sorted(set(found))


def found_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def make():
        net = Net.load(shared.value)

        def run(raw):
            texts = [x.decode("utf-8", "replace") for x in raw]
            base = [base_spans(t) for t in texts]
            every = [list(b) for b in base]
            for i, s, e in secret_candidates(net, texts, base):
                every[i].append((s, 3, e))
            out = {f"n_{KINDS[k]}": [sum(s[1] == k for s in b) for b in base] for k in range(3)}
            out["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            out["spans"] = [joined(sorted(e)) for e in every]
            return out

        return run

    make.factory = True
    return map_texts(docs, make, {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"})
