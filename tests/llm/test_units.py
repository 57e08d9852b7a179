"""Words are put together from units that no piece crosses, so that what is searched is less and the ids stay the same."""

import random

import numpy as np

from tidemark.llm import pieces


def test_words_of_known_units_are_not_searched_again():
    p = pieces.Pieces(pieces.default_path())
    e, plain = pieces.Encoder(p), pieces.Encoder(p)
    rnd = random.Random(6)
    stems = ["".join(rnd.choice("abdeinorst") for _ in range(6)) for _ in range(30)]
    words = [a + mark + b for a in stems for b in stems for mark in ("$$$", "\n\n", "\U0001f600", "\ud800")]
    searched = []
    add = e.add
    e.add = lambda new: add(searched.extend(new := list(new)) or new)
    got = e.coded(words)
    assert len(searched) < len(words) / 10  # each stem and mark once; before, each word
    for w, x in plain.add(words):
        assert got[words.index(w)] == x
    units, at = e.units(["", "a", stems[0] + "$$$", ""])
    assert at[:2] == [0, 0] and at[-1] == at[-2] == len(units) and "".join(units) == "a" + stems[0] + "$$$"
    assert e.units([]) == ([], [0])


def test_a_worker_keeps_its_encoder_from_task_to_task():
    p = pieces.Pieces(pieces.default_path())
    assert pieces._encoder(p) is pieces._encoder(p)


def test_only_new_words_are_looked_up_among_old_ones():
    class Old(dict):
        def __iter__(self):
            raise AssertionError("goes through all that is remembered")  # before, for every some hundred thousand characters

    e = pieces.Encoder(pieces.Pieces(pieces.default_path()))
    was = e.coded(["▁one", "▁two"])
    e.old, e.young = Old(e.young), {}
    assert e.coded(["▁two", "▁three", "▁one"])[::2] == was[::-1] and set(e.young) >= {"▁one", "▁two"}


def test_a_character_is_one_step_and_ids_are_those_of_merging():
    p = pieces.Pieces(pieces.default_path())
    rnd = random.Random(7)
    words = ["▁" * (k % 3) + "".join(rnd.choice("aeinorstdh\n$é\U0001f600\ud800") for _ in range(rnd.randrange(1, 14))) for k in range(600)]
    for most in (1 << 18, 3):  # what is remembered changes nothing
        e = pieces.Encoder(p, most_pairs=most)
        steps = []
        reads = e.reads
        e.reads = lambda at, c: steps.append((at[""], c)) or reads(at, c)
        for w, ids in e.add(words):
            want = [i for x in p.merged(w) for i in ([p.ids[x]] if x in p.ids else [p.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")])]
            assert np.frombuffer(ids, np.int32).tolist() == want
        if most > 3:
            assert len(steps) == len(set(steps)) < sum(map(len, words)) / 2  # each end and next character are looked for once
