from __future__ import annotations

import re

from test_text import labelled

from veilspark.llm import personal as P

WRAPPED = "Die Verwaltung hat das Gesuch geprüft und dabei auch mit Hans\nMeier gesprochen, der in der Sache schon früher schriftlich\nStellung nahm und weitere Unterlagen in Aussicht gestellt\nhatte, die nun vorliegen."


def finder():
    rows, given, family = labelled()
    return P.learn(rows, given, family)


def test_a_long_line_does_not_stop_the_joining_of_others():
    for text in (WRAPPED, "x" * 115 + "\n" + WRAPPED, WRAPPED + "\n\n" + "y " * 200):
        plain, at = P.unwrapped(text)
        assert "Hans Meier" in plain and "schriftlich Stellung" in plain
        a = plain.index("Hans Meier")
        assert text[at[a] : at[a + 9] + 1] == "Hans\nMeier"
    for text in ("Nome: Ugo Valetteri-Scavasini\nNumero AVS: 756", "Freundliche Grüsse aus dem Amt\nAnna Keller", "a" * 200 + "\nAnna"):
        assert P.unwrapped(text)[0] == text


def test_long_names_streets_and_mail_names_are_proposed():
    lexicon = finder().lexicon
    spans = lambda text, tag: {text[a:b] for t, a, b, _ in P.candidates(text, lexicon) if t == tag}
    name = "Anna Carla Zita Bruno Waldacher"
    assert name in spans(f"Anwesend war {name} selbst.", 0)
    people = "Urs Waldacher, Anna Steihofer, Carla Goldacher, Bruno Brunhofer, Zita Lütacher, Urs Steihofer"
    assert set(people.split(", ")) <= spans(f"Anwesend waren {people}.", 0)
    assert spans(f"sie wohnt {people}, {name} hier", 0) >= {name, *people.split(", ")}
    street = "Chemin de la petite croix de la grande pierre noire 12"
    assert street in spans(f"Elle habite au {street}, 1200 Genève.", 6) and "Rue de la gare 4" in spans("Il habite Rue de la gare 4, ici.", 6)
    assert "12 Old Mill Lane" in spans("She lives at 12 Old Mill Lane, London.", 6)
    mail = "a" * 90 + "." + "b" * 200 + "@amt.example"
    assert mail in spans(f"an {mail} gesandt", 2) and "jean.dupont arobase poste point ch" in spans("à jean.dupont arobase poste point ch merci", 2)


def test_long_runs_stay_linear_and_kept_spans_do_not_overlap():
    lexicon = finder().lexicon
    found = P.candidates("Anna " * 3000, lexicon)
    assert len(found) < 8 * 3000
    text = "Urs Waldacher, Anna Steihofer. " * 400
    kept = finder().batch([text])[0]
    assert all(a[2] <= b[1] for a, b in zip(kept, kept[1:])) and len(kept) > 300
    assert not finder().batch(["x" * 50_000 + "! 12 " + "y" * 50_000, re.sub(".", "A ", "x" * 2000)])[0]
