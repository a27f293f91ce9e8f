"""Numpy kernels against slow versions that follow the definitions one number at a time."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from sievemark.llm import fingerprints, language, packing, quality
from sievemark.llm.common import words_of

from .conftest import corpus, prose

M = (1 << 64) - 1


def slow_probability(net, text):
    """Byte windows of 8 every 4 bytes; blocks of 256; chunks of two blocks that overlap by one."""
    n = -(-(len(text) + quality.WIDTH) // quality.BLOCK)
    data = text + bytes(n * quality.BLOCK + quality.WIDTH - len(text))
    tops = []
    for b in range(n):
        best = np.full(quality.FILTERS, -np.inf)
        for k in range(quality.BLOCK // quality.STRIDE):
            p = b * quality.BLOCK + k * quality.STRIDE
            z = sum(net.filters[j][data[p + j]].astype(np.float64) for j in range(quality.WIDTH))
            if b == n - 1 and p + quality.WIDTH > n * quality.BLOCK:
                z = np.zeros(quality.FILTERS)
            best = np.maximum(best, z)
        tops.append(np.maximum(best + net.bias, 0))
    chunks = [np.maximum(a, b) for a, b in itertools.pairwise(tops)] or tops
    x = float(np.concatenate([np.max(tops, axis=0), np.mean(chunks, axis=0)]) @ net.out + net.shift)
    return 1 / (1 + math.exp(-x))


def test_network_against_loops(monkeypatch):
    rng = random.Random(3)
    texts = [b"", b"a", prose(rng, 40).encode(), prose(rng, 200).encode(), "漢字 é".encode() * 90, bytes(range(256)) * 3, b"x" * 248, b"x" * 249]
    net = quality.ByteNet().fit(texts[2:6] * 4, np.array([1, 0, 1, 0] * 4, np.float32), 2)
    want = [slow_probability(net, t) for t in texts]
    assert net.forward(texts)[0] == pytest.approx(want, abs=1e-5)
    for blocks in (1, 2, 5):
        monkeypatch.setattr(quality, "BLOCKS", blocks)
        assert net.scores(texts) == pytest.approx(want, abs=1e-5)


def slow_words(model, text):
    """Log-likelihood of each word of letters: mean over orders of its n-grams' logarithms, with the break before and after it."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    words = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in low).split()
    out = []
    for w in words:
        s, total = b" " + w + b" ", np.zeros(len(model.names))
        for end, (j, n) in itertools.product(range(1, len(s)), enumerate(language.ORDERS)):
            if end - n + 1 >= 0:
                code = int.from_bytes(s[end - n + 1 : end + 1], "big") & 0xFFFFFFFF
                slot = ((code * 2654435761 & 0xFFFFFFFF) ^ (n * 0x5BD1E995 & 0xFFFFFFFF)) >> (32 - model.bits)
                total += model.log[:, j, slot]
        out.append(total / len(language.ORDERS))
    return np.array(out).T


def slow_choice(score):
    """The set of languages with the best penalised likelihood, of all sets, and its shares by many rounds of EM."""
    n, words = score.shape
    like = np.exp(np.maximum(score - score.max(axis=0), -60))
    best = (-math.inf, None)
    for size in range(1, n + 1):
        for some in itertools.combinations(range(n), size):
            share = np.full(size, 1 / size)
            for _ in range(60):
                part = share[:, None] * like[list(some)]
                share = (part / part.sum(axis=0)).mean(axis=1)
            value = np.log((share[:, None] * like[list(some)]).sum(axis=0)).sum() - language.PENALTY * size * math.log(words + 1)
            best = max(best, (value, (some, share.tolist())))
    some, share = best[1]
    return some[int(np.argmax(share))], max(share)


def test_languages_against_loops():
    rng = random.Random(11)
    kinds = [[prose(rng, 60, lang).encode() for _ in range(30)] for lang in ("de", "en")] + [[b"ola que tal amigo vamos a la playa con el perro " * 3] * 5]
    model = language.Languages(["de", "en", "es"]).fit(kinds)
    texts = [prose(rng, 30, "en"), prose(rng, 3, "de"), prose(rng, 40, "en") + " " + prose(rng, 25, "de"), "ola que tal amigo " * 4 + prose(rng, 40, "de"), "A-B c3d, É!"]
    for t in (t.encode() for t in texts):
        score = slow_words(model, t)
        assert model.word_scores([t]) == pytest.approx(score, abs=1e-4)
        lang, share = model.predict([t])
        want, most = slow_choice(score)
        assert lang[0] == want and share[0] == pytest.approx(most, abs=0.03)


def slow_mix(x):
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & M
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 33


def slow_fingerprint(f, text):
    words = words_of(text)
    if not words:
        return None
    h, k = [xxhash.xxh64_intdigest(w) for w in words], min(f.shingle, len(words))
    least = {}
    for i in range(len(h) - k + 1):
        s = slow_mix(sum(h[i + j] * int(f.weights[j]) for j in range(k)) + k & M)
        least[s >> 56] = min(s, least.get(s >> 56, M))
    out = []
    for b in range(f.bins):
        donor = b if b in least else next((int(d) for d in f.donors[:, b] if int(d) in least), None)
        if donor is None:  # no attempt met a value: the next bin that has one
            donor = next(x % f.bins for x in range(b, b + f.bins) if x % f.bins in least)
        out.append(slow_mix(least[donor] + int(f.salt[b]) & M) & (1 << f.bits) - 1)
    return out


def test_fingerprints_against_loops():
    f = fingerprints.Fingerprints()
    for _, t in corpus(25):
        t = (t or "").encode()
        got, want = f.values(t), slow_fingerprint(f, t)
        assert (got is None) == (want is None) and (got is None or got.tolist() == want)
        digits = "".join(f"{a | b << 4:02x}" for a, b in zip((want or [0] * f.bins)[::2], (want or [0] * f.bins)[1::2], strict=True))
        assert f.packed(got) == digits


def slow_place(demand, limits):
    """The open sequence takes, of the pieces that fit, the one with the largest dot product of demand and room."""
    left, begin, alive, out = [list(map(float, d)) for d in demand], [0] * len(demand), list(range(len(demand))), []
    while alive:
        room, seq = list(map(float, limits)), []
        while room[0] >= 1 and room[1] >= 1:
            fitting = [i for i in alive if all(a <= r for a, r in zip(left[i], room, strict=True))]
            if fitting:
                i = max(fitting, key=lambda i: (sum(a * r / x**2 for a, r, x in zip(left[i], room, limits, strict=True)), -i))
                seq.append((i, begin[i], int(left[i][0])))
                room = [r - a for r, a in zip(room, left[i], strict=True)]
                alive.remove(i)
                continue
            share = lambda i: math.ceil(room[0] * left[i][2] / max(1, left[i][0]))
            longer = [i for i in alive if left[i][0] > room[0] and left[i][1] <= room[1] and share(i) <= room[2]]
            if longer:
                i, take = longer[0], int(room[0])
                seq.append((i, begin[i], take))
                left[i] = [left[i][0] - take, left[i][1], left[i][2] - min(share(i), left[i][2])]
                begin[i] += take
            break
        if not seq:
            i = alive[0]
            take = max(1, int(left[i][0] * limits[2] // left[i][2]))
            seq.append((i, begin[i], take))
            left[i] = [left[i][0] - take, left[i][1], left[i][2] - math.ceil(take * left[i][2] / left[i][0])]
            begin[i] += take
        out.append(seq)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_placement_against_loops(seed):
    """All three limits bind: short pieces run into the limit on segments, those that bear loss into that on loss."""
    rng = random.Random(seed)
    limits = (64, rng.choice((3, 8)), rng.choice((24, 48)))
    demand = [(n, 1, rng.choice((0, n // 3, n))) for n in (rng.choice((2, 5, 17, 40, 63)) for _ in range(40))]
    got = packing.place(np.array(demand, float), np.array(limits))
    assert got == slow_place(demand, limits)
    assert all(sum(n for _, _, n in s) <= limits[0] and len(s) <= limits[1] for s in got)
    assert sum(n for s in got for _, _, n in s) == sum(d[0] for d in demand)
