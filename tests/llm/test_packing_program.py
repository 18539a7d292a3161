"""The configuration program against best-fit decreasing, bounds and brute force; tokens against the library."""

import random
from collections import Counter
from itertools import product

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = {25: 698, 32: 1344, 46: 655, 54: 659, 59: 644}


def best_fit_decreasing(hist, cap):
    rooms, n = [], 0
    for x in sorted(Counter(hist).elements(), reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            n += 1
            rooms.append(cap - x)
        else:
            rooms.remove(fit)
            rooms.append(fit - x)
    return n


def number(hist, cap):
    used = Counter()
    configs = packing.plan(hist, cap)
    for m, c in configs:
        assert m > 0 and sum(n * a for n, a in c.items()) <= cap
        used.update({n: m * a for n, a in c.items()})
    assert used == Counter(hist)
    return sum(m for m, _ in configs)


def test_hard_histogram_is_packed_as_well_as_it_can_be():
    p = packing.Program(HARD, 100)
    assert number(HARD, 100) <= 1710 <= 1.01 * p.bound + len(HARD) + 10


@pytest.mark.parametrize("seed", range(10))
def test_never_more_sequences_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = 100 if seed % 5 else 600
    lengths = rng.sample(range(cap // rng.choice([20, 8, 4]), cap * 2 // 3), rng.choice([3, 6, 12, 20]))
    hist = {n: rng.randrange(1, 300) for n in lengths}
    assert number(hist, cap) <= best_fit_decreasing(hist, cap)


def test_bound_and_plan_enclose_the_least_number():
    hist, cap = {3: 3, 5: 2, 4: 3}, 10

    def least(left):
        if not any(left):
            return 0
        fits = [c for c in product(*[range(min(k, cap // n) + 1) for n, k in zip(hist, left)]) if 0 < sum(a * n for a, n in zip(c, hist)) <= cap]
        full = [c for c in fits if not any(all(x <= y for x, y in zip(c, d)) and c != d for d in fits)]
        return 1 + min(least(tuple(k - a for k, a in zip(left, c))) for c in full)

    want = least(tuple(hist.values()))
    assert packing.Program(hist, cap).bound <= want + 1e-9 and number(hist, cap) == want


def test_knapsack_against_all_choices():
    rng = random.Random(2)
    import numpy as np

    for _ in range(20):
        cap, lengths = 23, rng.sample(range(2, 15), 4)
        price = np.full(cap + 1, -np.inf)
        for n in lengths:
            price[n] = rng.random()
        best, _ = packing.priced(price, cap)
        want = max(sum(a * price[n] for a, n in zip(c, lengths)) for c in product(range(12), repeat=4) if sum(a * n for a, n in zip(c, lengths)) <= cap)
        assert abs(best[cap] - want) < 1e-12


def test_equal_lengths_and_nothing():
    assert number({7: 5}, 7) == 5 and number({50: 9, 51: 9}, 100) == 14 and packing.plan({}, 9) == []
    with pytest.raises(ValueError):
        packing.plan({8: 1}, 7)


def test_texts_cut_at_stops_give_the_library_s_tokens():
    rng, alphabet = random.Random(8), ["a", "B", "é", "É", ".", ",", "!", "'", "'s", "'T", "3", " ", "\n", "́", "<|endoftext|>", "|>", "　", "\xa0", "ß", "Σ", "\x1c", "—", "it's", "x.y"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(400)] + ["", "z" * 5000]
    tokenizer = Tokenizer.from_file(PATH)
    ids, begin = packing.token_ids([t.encode() for t in texts], packing.KnownPieces(PATH))
    for i, t in enumerate(texts):
        assert ids[begin[i]:begin[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [0], repr(t)
