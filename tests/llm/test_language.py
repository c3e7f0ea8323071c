from __future__ import annotations

from veilspark.llm import language as L

WORDS = {
    "de": "Die Verwaltung hat das Gesuch geprüft und wird den Antrag später behandeln, weil noch Unterlagen fehlen.",
    "fr": "La commission a examiné la demande et elle la traitera plus tard, car il manque encore des pièces au dossier.",
    "it": "La commissione ha esaminato la domanda e la tratterà più tardi, perché mancano ancora alcuni documenti.",
    "en": "The office has checked the request and will deal with it later, because some of the papers are still missing.",
    "es": "La oficina examinó la solicitud y la tratará más adelante, porque todavía faltan algunos documentos.",
}


def test_a_number_with_a_stop_ends_a_sentence_or_not():
    model = L.train({k: [v + f" {i}." for i in range(30)] for k, v in WORDS.items()})
    count = lambda text: [ended for _, _, ended, _, _ in model.sentences(text)]
    for text in ("Composez le 031 555 66 30.", "Composez le 031 555 66\n30.", "Sie wohnt an der Bachgasse 12."):
        assert count(text) == [True], text
        assert count(f"{text} Die Rechnung ist da.") == [True, True], text
        assert count(f"{text}\n\nDie Rechnung ist da.") == [True, True], text
    for text in ("Am 15. Dezember kam sie.", "Am 3. Feb-\nruar kam sie.", "Am 5. 12. 2020 kam sie.", "Sie besucht die 3. Klasse.", "Es ist das 2. mal so.", "3. Traktandum der Sitzung."):
        assert count(text) == [True], text
    found = model.passages("La commission a examiné la demande car il manque encore le 031 555 66 30. Die Verwaltung hat das Gesuch geprüft und wird den Antrag später behandeln, Tel. 031 555 66 31.")
    assert [(x[2], x[4]) for x in found] == [("fr", True), ("de", True)]
