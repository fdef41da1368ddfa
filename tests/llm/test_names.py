import random

import pytest

from rallyframe.llm import names as n


def test_automaton_equals_dynamic_programming():
    rng = random.Random(1)
    word = lambda lo, hi: "".join(rng.choice("abde") for _ in range(rng.randint(lo, hi)))
    ws, qs = sorted({word(3, 8) for _ in range(500)}), sorted({word(1, 10) for _ in range(250)})
    for k in (1, 2):
        automaton, got = n.Automaton(k), set()
        for length in {len(w) for w in ws}:
            trie = n.Trie([w for w in ws if len(w) == length])
            got |= {(qs[a], trie.words[b], int(e)) for a, b, e in zip(*trie.near(qs, automaton))}
        assert got == {(a, b, n.edit_distance(a, b, k)) for a in qs for b in ws if n.edit_distance(a, b, k) <= k}


PEOPLE = [("1", "Leandrik Kujofegor"), ("2", "Norbelan von Gisavmumi"), ("3", "Boromir Gévniduma-Halbi"), ("4", "Petronik O'Natoryelde"), ("5", "Lucidan Kalmofegor"), ("6", None), (None, "No One"), ("1", "Leandrik Kujofegor"), ("7", "Timofran Corvalin Limagizen"), ("8", "Zhe Li"), ("9", "Anbelo Ó"), ("10", "Kara " + "Longo" * 20), ("11", "Otmar Délporta")]
SPELLED = [
    ("Kujofegor L.", "1"), ("  LEANDRIK-KUJOFEGOR ", "1"), ("Kujofgeor, Leandrik Jr.", "1"), ("L. Kujofegor", "1"), ("Leandri Kujoffegor", "1"), ("Elan Gisavmumi", "2"), ("norbelan gisavmumi", "2"), ("Borry Gevniduma", "3"), ("boromir halbi gevniduma", "3"), ("Petronik ONatoryelde", "4"), ("Natoryelde O'Petronik", "4"), ("Li Z.", "8"), ("Zhe Li", "8"), ("LI, ZHE", "8"), ("Ó Anbelo", "9"), ("K. " + "Longo" * 20, "10"), ("Kara " + "Longo" * 10 + "x" + "Longo" * 10, "10"), ("Del Dèlportta", "11"),
    (" ".join(["o", "a", "e", "u", "p", "q", "r", "s", "t", "v", "w", "x"]) + " Kujofegor", None), ("Leandrik " * 14 + "Kujofegor", "1"), (" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)) + " Kujofegor", None),
    ("Nory GisavmumiX", "2"), ("Kalmofegor L.", "5"), ("Limagizen T.-C.", "7"), ("Timofran Limagizen", "7"), ("Somebody Else", None), ("", None), ("...", None), (None, None), ("Leandrik Kujofegor", "1"), ("x" * 5000, None), ("a " * 3000, None),
]


@pytest.mark.parametrize("sizes", [(50_000, 20_000), (1, 2)])
def test_links(spark, monkeypatch, sizes):
    monkeypatch.setattr(n, "SHARD_NAMES", sizes[0])
    monkeypatch.setattr(n, "BLOCK_FORMS", sizes[1])
    typed = spark.createDataFrame([(s, "c") for s, _ in SPELLED * 2], "spelling string, player_id string")
    got = {r.spelling: r.player_id for r in n.link_names(typed, spark.createDataFrame(PEOPLE, "player_id string, name string")).collect()}
    assert {s: got.get(s) for s, _ in SPELLED} == dict(SPELLED)


def test_margin_and_empty_tables(spark):
    people = spark.createDataFrame([("1", "Ana Belmonto"), ("2", "Ana Belmonta")], "player_id string, name string")
    typed = spark.createDataFrame([("Ana Belmonti",), ("Ana Belmonto",)], "spelling string")
    got = {r.spelling: (r.player_id, r.margin) for r in n.link_names(typed, people).collect()}
    assert got["Ana Belmonti"] == ("1", 0.0) and got["Ana Belmonto"][0] == "1"
    assert n.link_names(typed.limit(0), people).count() == 0 and n.link_names(typed, people.limit(0)).count() == 0
