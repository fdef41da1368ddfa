import random
from functools import reduce

import pytest

from rallyframe.llm import text_quality as t

PIECES = ["The boat is on the lake. ", "stand gate bell mast net wall\n", "- a small engine\n", "| a | 1 | 2.0 |\n", "id=3f rc=1\n", "12;34;56\n", "\n", "  \n", "Was tut er? ", "d'une chose à l'autre, ", "x", "ß", "…”\n", "%§+|}@\n", "un"]


def whole(text, n):
    flat = t.finish(reduce(t.combine, [t.partial(text[i : i + n]) for i in range(0, max(1, len(text)), n)]))
    assert flat == t.finish(t.counted(text, n))
    return flat


@pytest.mark.parametrize("n", [1, 3, 10, 29])
def test_chunks_merge_to_the_whole(n):
    rng = random.Random(n)
    for _ in range(60):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12)))
        assert whole(text, n) == t.finish(t.partial(text))


@pytest.mark.parametrize(("line", "junk"), [
    ("The map maker measured the water tower near the lake.", False), ("voisin discret", False), ("de", False), ("Der Fährmann wollte die Kasse!", False), ("the bus driver counted the green gate of the", False), ("“Die Hafenbeamtin trug die Anzeige”, sagte Rudona vor dem Regen", False), ("3. The map maker measured the radio mast.", False),
    ("- the water tower", True), ("• un petit moteur", True), ("3) the north wall", True), ("7: Une paire de chaussures grises", True), ("path > draft > letter", True), ("the library staff\t706\t87%\tC", True), ("| the summer timetable | 833 | 13.39 |", True), ("bois_95 = 7132", True), ("[09:56] id=056de1 rc=1 len=416", True), ("7271;1539;7354", True), ("%+¤\\|^~|>\\$_*//§¤|&", True), ("shoes shoes shoes shoes shoes", True), ("Netz Übungsfläche Farbe Pforte Kasse", True), ("bœ×Ð¶Ÿ¤½ï0a¼a½¶cÃyÑcâz", True),
])
def test_lines(line, junk):
    assert t.is_junk(t._line(line)) is junk


@pytest.mark.parametrize("blank", [" " * 30, "\u2003\u00a0" * 20])
def test_blanks_around_a_line_change_nothing(blank):
    for line, junk, end in (("The walls hold.", 0, 1), ("- the water tower", 1, 0), ("a)", 1, 0), ("the map", 0, 0)):
        for text in (blank + line, line + blank, blank + line + blank):
            want = t.partial("\n" + text + "\n")["sums"]
            assert (want["junk_lines"], want["line_ends"]) == (int(junk and (line != "a)" or text.endswith(blank))), end)
            for n in (1, 7, 25):
                assert whole(text, n) == t.finish(t.partial(text))


@pytest.mark.parametrize(("line", "junk", "end"), [("-" * 40 + " the water tower", 1, 0), ("The walls hold." + "”’)" * 20, 0, 1), ("The boat is in the port" + " ”" * 20, 0, 0), ("x" * 5000, 1, 0), ("x" * 30 + ".", 1, 1), ("> " * 30 + "the map", 1, 0)])
def test_long_ends_of_a_line_are_read(line, junk, end):
    want = t.partial("\n" + line + "\n")["sums"]
    assert (want["junk_lines"], want["line_ends"]) == (junk, end)
    for n in (1, 7, 25):
        assert whole(line, n) == t.finish(t.partial(line))


def test_documents_long_and_short(spark):
    prose, junk = "The boat is on the lake. It was very cold there.\n" * 40, "- a small engine\nstand gate bell mast net\n" * 30
    rows = [(1, prose, "a"), (2, junk, "a"), (3, None, "a"), (4, "", "a"), (5, "x" * 5000, "a"), (1, prose, "b"), (None, prose, "c"), (6, prose + junk, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    key = lambda d: sorted(map(tuple, d.collect()))
    base = key(t.text_quality(df))
    assert len(base) == 7 and [r[0] for r in base if r[-1]] == [1, 1] and base[0][1] == 440
    assert [r[1:] for r in base if r[0] in (3, 4)] == [(0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, False)] * 2
    for n in (7, 100):
        assert key(t.text_quality(df, chunk_chars=n)) == base
    assert t.text_quality(df.limit(0)).count() == 0
