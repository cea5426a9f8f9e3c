"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions, decoding."""

from __future__ import annotations

import random

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_TAGS = len(TAGS)
#: Characters with a class of their own; digits share one, as do other letters and the rest.
_OWN = "abcdefghijklmnopqrstuvwxyz@.-+()[]_%:,/ \n"
DIGIT, LETTER, OTHER, PAD = len(_OWN), len(_OWN) + 1, len(_OWN) + 2, len(_OWN) + 3
CLASSES = PAD + 1
WINDOW, STRIDE = 64, 32
_TABLE = np.full(0x250, OTHER, np.uint8)
for _i, _c in enumerate(_OWN):
    _TABLE[ord(_c)] = _TABLE[ord(_c.upper())] = _i
_TABLE[ord("0") : ord("9") + 1] = DIGIT
for _i in range(0xC0, 0x250):
    _TABLE[_i] = LETTER if chr(_i).isalpha() else OTHER


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, hidden: int = 24, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.hidden = h
        self.p = {f"x{d}": draw(CLASSES, 4 * h) for d in "fb"} | {f"h{d}": draw(h, 4 * h) * 0.5 for d in "fb"}
        for d in "fb":
            self.p[f"x{d}"][:, h : 2 * h] += 1.0  # gates begin open to what was
        self.p |= {"out": draw(2 * h, N_TAGS), "bias": np.zeros(N_TAGS, np.float32), "trans": np.zeros((N_TAGS, N_TAGS), np.float32)}

    def _forward(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (time, batch, hidden) of one direction, and what training needs of each step."""
        steps, n, h = x.shape[1], x.shape[0], self.hidden
        state = cell = np.zeros((n, h), np.float32)
        out, saved = np.empty((steps, n, h), np.float32), [None] * steps
        table, recurrent = self.p[f"x{d}"], self.p[f"h{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + state @ recurrent
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, was = cell, state
            cell = f * cell + i * g
            c = np.tanh(cell)
            state = o * c
            out[t] = state
            if keep:
                saved[t] = (i, f, o, g, c, before, was)
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of the tags for windows of character classes: (batch, time, tags)."""
        both = np.concatenate([self._forward(x, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def _backward(self, x: np.ndarray, d: str, saved: list, slope: np.ndarray, grads: dict) -> None:
        h, recurrent = self.hidden, self.p[f"h{d}"]
        steps = x.shape[1]
        ds = dc = np.zeros((x.shape[0], h), np.float32)
        slopes = np.empty((steps, x.shape[0], 4 * h), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            i, f, o, g, c, before, _ = saved[t]
            ds = ds + slope[t]
            dc = dc + ds * o * (1 - c * c)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * c * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            slopes[t] = dz
            ds, dc = dz @ recurrent.T, dc * f
        # all steps in one product each
        flat = slopes.reshape(-1, 4 * h)
        hot = np.zeros((len(flat), CLASSES), np.float32)
        hot[np.arange(len(flat)), x.T.ravel()] = 1
        grads[f"x{d}"] += hot.T @ flat
        grads[f"h{d}"] += np.concatenate([s[6] for s in saved]).T @ flat

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood, and its slopes by emissions (batch, time, tags) and transitions."""
        n, steps, _ = e.shape
        trans = self.p["trans"].astype(np.float64)
        scores = e.astype(np.float64).transpose(1, 0, 2)
        # sums over sequences as products, scaled at each step so that none overflows
        high = scores.max(axis=2, keepdims=True)
        odds, move = np.exp(scores - high), np.exp(trans - trans.max())
        alpha, beta, scale = np.empty_like(odds), np.ones_like(odds), np.empty((steps, n, 1))
        for t in range(steps):
            a = odds[t] if not t else alpha[t - 1] @ move * odds[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (odds[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
        log_z = np.log(scale).sum() + high.sum() + n * (steps - 1) * trans.max()
        de = (alpha * beta).transpose(1, 0, 2).copy()
        pair = alpha[:-1].reshape(-1, N_TAGS).T @ (odds * beta / scale)[1:].reshape(-1, N_TAGS) * move
        rows, at = np.arange(n)[:, None], np.arange(steps)[None]
        score = e[rows, at, y].sum(dtype=np.float64) + trans[y[:, :-1], y[:, 1:]].sum()
        de[rows, at, y] -= 1
        np.add.at(pair, (y[:, :-1], y[:, 1:]), -1)
        return float((log_z - score) / n), (de / n).astype(np.float32), (pair / n).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam on windows of character classes and tags; the loss of each step."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            xs, ys = x[rows], y[rows]
            runs = {d: self._forward(xs, d, True) for d in "fb"}
            both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
            loss, de, dt = self._crf((both @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2), ys)
            de = de.transpose(1, 0, 2)
            grads = {k: np.zeros_like(a) for k, a in self.p.items()}
            grads["trans"], grads["bias"] = dt, de.sum(axis=(0, 1))
            grads["out"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, N_TAGS)
            slope = de @ self.p["out"].T
            for k, d in enumerate("fb"):
                self._backward(xs, d, runs[d][1], slope[:, :, k * self.hidden : (k + 1) * self.hidden], grads)
            norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g *= min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(loss)
        return losses

    def stitched(self, regions: list[np.ndarray], rows: int = 1024) -> list[np.ndarray]:
        """Emissions of whole regions: where windows overlap, their mean, weighted to their middles."""
        jobs = [(k, at) for k, r in enumerate(regions) for at in range(0, max(1, len(r) - STRIDE), STRIDE)]
        sums, weights = ([np.zeros((len(r), k), np.float32) for r in regions] for k in (N_TAGS, 1))
        shape = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        for j in range(0, len(jobs), rows):
            x = np.full((len(jobs[j : j + rows]), WINDOW), PAD, np.uint8)
            for i, (k, at) in enumerate(jobs[j : j + rows]):
                part = regions[k][at : at + WINDOW]
                x[i, : len(part)] = part
            for (k, at), e in zip(jobs[j : j + rows], self.emissions(x), strict=True):
                n = min(WINDOW, len(regions[k]) - at)
                sums[k][at : at + n] += e[:n] * shape[:n]
                weights[k][at : at + n] += shape[:n]
        return [s / w for s, w in zip(sums, weights, strict=True)]

    def decode(self, emissions: list[np.ndarray], length: int = 256, rows: int = 512) -> list[np.ndarray]:
        """The best sequence of tags of each region, whatever its length: one Viterbi pass, in chunks.

        What a chunk makes of the scores before it is a matrix (best way from each tag to each), so chunks are
        worked off side by side: their matrices give the scores at which each chunk of a region begins, a second pass
        keeps the ways back, and the chunks' ways are joined from the last to the first.
        """
        trans = self.p["trans"].astype(np.float32)
        chunks = [(k, at) for k, e in enumerate(emissions) for at in range(0, max(len(e), 1), length)]
        before = self._entries(emissions, chunks, trans, length, rows)
        out, ways = [np.zeros(len(e), np.int8) for e in emissions], {}
        chunks.sort(key=lambda c: min(length, len(emissions[c[0]]) - c[1]))
        for j in range(0, len(chunks), rows):
            mine = chunks[j : j + rows]
            e, size = _grid(emissions, mine, length)
            first = np.array([c in before for c in mine])
            score = e[:, 0].copy()
            back = np.zeros((e.shape[1], len(mine), N_TAGS), np.int8)
            if first.any():
                s = np.stack([before[c] for c in mine if c in before])[:, :, None] + trans
                back[0, first] = s.argmax(axis=1)
                score[first] += s.max(axis=1)
            for t in range(1, e.shape[1]):
                s = score[:, :, None] + trans
                back[t] = s.argmax(axis=1)
                score = np.where((t < size)[:, None], s.max(axis=1) + e[:, t], score)
            # from every last tag the way to the first, and to the last tag of the chunk before
            tag = np.broadcast_to(np.arange(N_TAGS, dtype=np.int8), (len(mine), N_TAGS))
            way = np.zeros((e.shape[1], len(mine), N_TAGS), np.int8)
            for t in range(e.shape[1] - 1, -1, -1):
                way[t] = tag
                tag = np.where((t < size)[:, None], np.take_along_axis(back[t], tag.astype(np.int64), axis=1), tag)
            best = score.argmax(axis=1)
            for i, (k, at) in enumerate(mine):
                n = int(size[i])
                if not at and n == len(emissions[k]):
                    out[k][:] = way[:n, i, best[i]]
                else:
                    ways[k, at] = way[:n, i].copy(), tag[i].copy(), int(best[i])
        for k, e in enumerate(emissions):
            if len(e) > length:
                last = None
                for at in range((len(e) - 1) // length * length, -1, -length):
                    way, entry, best = ways.pop((k, at))
                    last = best if last is None else last
                    out[k][at : at + len(way)] = way[:, last]
                    last = int(entry[last])
        return out

    def _entries(self, emissions: list[np.ndarray], chunks: list[tuple[int, int]], trans: np.ndarray, length: int, rows: int) -> dict:
        """Of every chunk but a region's first, the best scores of the tags before it."""
        long = [c for c in chunks if len(emissions[c[0]]) > length]
        matrices = {}
        for j in range(0, len(long), rows):
            mine = long[j : j + rows]
            e, size = _grid(emissions, mine, length)
            m = trans + e[:, 0][:, None]  # from the tag before the chunk to its first
            for t in range(1, e.shape[1]):
                step = (m[:, :, :, None] + trans).max(axis=2) + e[:, t][:, None]
                m = np.where((t < size)[:, None, None], step, m)
            matrices.update(zip(mine, m, strict=True))
        out, score = {}, None
        for k, at in long:
            if not at:
                # the first chunk has nothing before it: its matrix without a transition
                e = emissions[k][:length]
                score = e[0].astype(np.float32)
                for t in range(1, len(e)):
                    score = (score[:, None] + trans).max(axis=0) + e[t]
            else:
                out[k, at] = score
                score = (score[:, None] + matrices[k, at]).max(axis=0)
            score = score - score.max()
        return out

    def sureness(self, emissions: list[np.ndarray], found: list[tuple[int, int, int, np.ndarray]], context: int = 16) -> np.ndarray:
        """found: region, start, end, tags.  The model's posterior of each span: that its characters have just these tags and the next isn't within it.

        By sums over all sequences of tags of the span and context characters on both sides.
        """
        trans, out = self.p["trans"].astype(np.float64), np.zeros(len(found))
        order = sorted(range(len(found)), key=lambda i: found[i][2] - found[i][1])
        for j in range(0, len(order), 256):
            mine = order[j : j + 256]
            ends = []
            parts = []
            for i in mine:
                k, a, b, tags = found[i]
                low, high = max(0, a - context), min(len(emissions[k]), b + context)
                e = emissions[k][low:high].astype(np.float64)
                only = np.zeros((high - low, N_TAGS))
                only[a - low : b - low] = -np.inf
                only[np.arange(a - low, b - low), tags] = 0.0
                if b < high:
                    only[b - low, (int(tags[-1]) + 1) // 2 * 2] = -np.inf  # the inner tag of the kind would go on
                parts.append((e, e + only))
                ends.append(high - low)
            size, z = np.array(ends), []
            for which in (0, 1):
                e = np.zeros((len(mine), int(size.max()), N_TAGS))
                for i, p in enumerate(parts):
                    e[i, : len(p[which])] = p[which]
                alpha = e[:, 0]
                for t in range(1, e.shape[1]):
                    s = alpha[:, :, None] + trans
                    top = s.max(axis=1)
                    new = e[:, t] + top + np.log(np.exp(s - top[:, None]).sum(axis=1))
                    alpha = np.where((t < size)[:, None], new, alpha)
                top = alpha.max(axis=1)
                z.append(top + np.log(np.exp(alpha - top[:, None]).sum(axis=1)))
            out[mine] = np.exp(np.minimum(0.0, z[1] - z[0]))
        return out


def _grid(emissions: list[np.ndarray], chunks: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunks' scores side by side, filled up with zeros, and their sizes."""
    size = np.array([min(length, len(emissions[k]) - at) for k, at in chunks])
    e = np.zeros((len(chunks), max(int(size.max(initial=1)), 1), N_TAGS), np.float32)
    for i, (k, at) in enumerate(chunks):
        e[i, : size[i]] = emissions[k][at : at + length]
    return e, size


def spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """kind, start and end of each run of one kind; a begin tag starts a new one."""
    out: list[list] = []
    for i, t in enumerate(tags.tolist()):
        if not t:
            continue
        kind, begins = KINDS[(t - 1) // 2], t % 2 == 1
        if not begins and out and out[-1][0] == kind and out[-1][2] == i:
            out[-1][2] = i + 1
        else:
            out.append([kind, i, i + 1])
    return [tuple(s) for s in out]


def examples(n: int, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled spans in invented text: texts and kind, start, end of what they hold.

    All kinds occur as they are written and as people hide or space them; what looks like them, but isn't, is as
    common: prose in rows of a table, licences, versions, keys, amounts, dates, ranges and numbers of other lengths.
    """
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=1, b=12: "".join(r.choice("etaoinshrdlucmfwypvbgkéüñçöèóß") for _ in range(r.randint(a, b)))
    plain = lambda a=2, b=9: "".join(r.choice("etaoinshrdlucmfwypvbgkqxzj") for _ in range(r.randint(a, b)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def host() -> str:
        return ".".join([plain() + r.choice(["", "", "", digits(1), "-" + plain(1, 4)]) for _ in range(r.randint(1, 2))] + [r.choice(["com", "org", "net", "de", "fr", "io", "es"])])

    def email() -> str:
        name = r.choice([plain(), f"{plain()}.{digits(2)}", f"{plain()}_{plain()}", f"{plain()}+{plain()}", plain() + digits(2), f"{plain()}.{plain()}", f"{plain(1, 1)}.{plain()}", f"{plain()}-{plain()}"])
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" [at] ", "."), (" (at) ", "."), ("[at]", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), ("@", " dot ")])
        return name + at + host().replace(".", dot)

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"+{digits(2)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{digits(11)}", f"00{digits(2)} {a} {b}{c}", f"1-{a}-{b}-{c}"]
        return r.choice(forms)

    def card() -> str:
        four = [r.choice("23456") + digits(3), digits(4), digits(4), digits(4)]
        return r.choice(["", "", "", " ", "-", ".", "  ", "_", " - "]).join(four)

    def ip() -> str:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice([".", ".", ".", ".", " . ", "[.]", "(.)", " dot ", "[dot]", "(dot)"]).join(parts)

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    row = lambda k: " | ".join(r.choice([word, word, lambda: digits(r.randint(1, 5))])() for _ in range(k))
    clean = [
        lambda: str(r.randint(1900, 2030)), lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"${r.randint(1, 999)}.{digits(2)}",
        lambda: f"{r.randint(1990, 2029)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(10, 23)}:{digits(2)}:{digits(2)}", lambda: f'{plain()} = "{hexes(r.choice([20, 32, 40]))}"', lambda: f"{plain()}={hexes(18)}",
        lambda: hexes(40), lambda: "AKIA" + hexes(16).upper(), lambda: f"{r.randint(1, 99)},{digits(3)},{digits(3)}", lambda: digits(r.choice([3, 5, 6, 7, 8, 9, 10, 11, 12, 13])), lambda: digits(r.choice([20, 21, 22, 24, 26, 30])), lambda: f"@{plain()}",
        lambda: f"{digits(2)} {digits(3)}", lambda: f"({r.randint(1, 40)})", lambda: f"{word()} at {word()}", lambda: f"{word()} at {word()} dot", lambda: f"{digits(3)}-{digits(2)}", lambda: f"https://{host()}/{plain()}{digits(3)}", lambda: f"{word()} (at) {word()}", lambda: f"look @ {word()}",
        lambda: " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(2, 9))), lambda: ", ".join(digits(r.randint(1, 4)) for _ in range(r.randint(2, 6))), lambda: row(r.randint(2, 6)), lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{r.randint(1, 40)}.{r.randint(1, 9)}.{r.randint(1, 9)}",
        lambda: r.choice(["Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3.", "CC BY-SA 4.0", "ISO 8859-1", "RFC 2616, section 4.2", "Copyright (c) 2019"]), lambda: f"{plain().capitalize()} {plain().capitalize()} {r.randint(1, 9)}.{r.randint(0, 9)}.",
        lambda: ".".join(digits(r.randint(1, 3)) for _ in range(r.choice([5, 6]))), lambda: ".".join(word() for _ in range(r.randint(2, 4))), lambda: "-".join(digits(r.randint(1, 5)) for _ in range(2)), lambda: f"{digits(4)} {digits(4)}",
    ]
    out = []
    for _ in range(n):
        text, found, shout, between = "", [], r.random() < 0.1, r.choice([" "] * 8 + [" | ", "!! ", "%% ", "\n"])
        while len(text) < WINDOW + 40:
            x = r.random()
            if x < 0.15:
                kind = r.choice(KINDS)
                piece = make[kind]()
                found.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = r.choice(clean)() if x < 0.35 else word()
                piece = piece.upper() if shout and "ß" not in piece else piece.capitalize() if r.random() < 0.1 else piece
            text += piece + r.choice([between] * 5 + [". ", ", ", "\n"])
        out.append((text, found))
    return out


def training_windows(labelled: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """A window of character classes and one of tags from each labelled text, anywhere in it."""
    rng = np.random.default_rng(seed)
    x, y = np.full((len(labelled), WINDOW), PAD, np.uint8), np.zeros((len(labelled), WINDOW), np.int64)
    for i, (text, found) in enumerate(labelled):
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in found:
            tags[a:b] = 2 * KINDS.index(kind) + 2
            tags[a] -= 1
        at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        part = classes(text)[at : at + WINDOW]
        x[i, : len(part)], y[i, : len(part)] = part, tags[at : at + WINDOW]
    return x, y


def trained(n: int = 12000, steps: int = 800) -> Tagger:
    tagger = Tagger(hidden=32)
    tagger.fit(*training_windows(examples(n)), steps)
    return tagger
