import random

import pytest

from casebook.functions import tries
from casebook.functions.edits import distance


@pytest.mark.parametrize("seed", range(12))
def test_automata_find_all_words_within_the_limit(seed, monkeypatch):
    """Also when many open branches make the walk go on in halves."""
    rnd = random.Random(seed)
    monkeypatch.setattr(tries, "FRONTIER", rnd.choice([40, 10**6]))
    word = lambda: "".join(rnd.choice("ab公\U0001f600") for _ in range(rnd.randint(0, 9)))
    trie = tries.Trie([word() for _ in range(rnd.randint(0, 40))])
    names, k = [word() for _ in range(rnd.randint(1, 30))], rnd.randint(0, 7)
    got = list(zip(*[x.tolist() for x in trie.within(names, k)]))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j, distance(n, w)) for i, n in enumerate(names) for j, w in enumerate(trie.words) if distance(n, w) <= k}
