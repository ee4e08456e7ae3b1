import random
from fractions import Fraction
from itertools import combinations

from millrace.functions import wrap as W


def brute(text, lines):
    """Of all ways to choose the breaks the one of least fault, in exact arithmetic; of equals that with the earlier breaks, from
    the last one back."""
    flat = " ".join(text.split())
    if not flat:
        return [""] if lines == 1 else None
    best = None
    for cuts in combinations(W.breaks(flat), lines - 1) if lines > 0 else ():
        edges = [0, *cuts, len(flat)]
        own = [flat[a:b].strip() for a, b in zip(edges, edges[1:], strict=False)]
        if not all(own):
            continue
        fault = sum(
            W.UNEVEN * (W.width(x) - Fraction(W.width(flat), lines)) ** 2 + max(W.width(x) - W.WIDEST, 0) * W.TOO_WIDE
            + (0 if b == len(flat) or flat[b - 1] in W.CLOSING + " " else W.INSIDE)
            for x, b in zip(own, edges[1:], strict=True)
        )
        if best is None or (fault, cuts[::-1]) < best[:2]:
            best = fault, cuts[::-1], own
    return best and best[2]


def test_laid_against_every_choice():
    rng = random.Random(3)
    letters = "ab cd  ef。，（你好）“x”1.2 é　​́"
    texts = ["db好a. ” áb///t​", "", " ", "a", "你" * 170 + "好 " * 12]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 22))) for _ in range(300)]
    for text in texts:
        for lines in (0, 1, 2, 3, 5):
            if len(text) < 30 or lines < 3:
                assert W.laid(text, lines) == brute(text, lines), (text, lines)


def test_laid_of_the_longest_text():
    """2,000 characters of short words: the table of places has hundreds of thousands of cells."""
    text = "so it is. " * 200
    rows = W.laid(text, 7)
    assert len(rows) == 7 and " ".join(rows) == text.strip() and max(map(len, rows)) - min(map(len, rows)) <= 10
