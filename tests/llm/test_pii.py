import re

from mailward.llm.pii import Feistel, luhn, pseudonymise, pseudonymise_texts, restored

TEXT = "Mail re.46@mail8.example.com or +1 (743) 555-3824, 555-3824; card 4785380592391139 and 4785 3805 9239 1139, not 4785380592391138. IP 152.143.123.131, 300.1.1.1, version 1.2.3. SSN 123-45-6789. On 2024-02-29 or 29/02/2024, not 2023-02-30. DE89 3704 0044 0532 0130 00 end 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e."


def test_round_trip_and_links():
    f = Feistel(b"k")
    new, spans = pseudonymise(TEXT, f)
    assert pseudonymise(new, f, back=True)[0] == TEXT
    assert [k for k, _, _ in spans] == ["email", "phone", "phone", "card", "card", "ipv4", "ssn", "date", "date", "iban", "secret"]
    got = [new[a:b] for _, a, b in spans]
    assert got[1][-8:] == got[2]
    assert got[3] == got[4].replace(" ", "") and luhn([int(c) for c in got[3]])
    assert got[7].split("-") == got[8].split("/")[::-1]
    assert "4785380592391138" in new and "300.1.1.1" in new and "2023-02-30" in new and "1.2.3" in new
    for old in re.findall(r"re\.46@|555-3824|4785380592391139|152\.143|123-45-6789|2024-02-29|2321bac4", TEXT):
        assert old not in new


def test_permutation_is_a_bijection():
    f = Feistel(b"k")
    assert len({tuple(f.permute([i // 10, i % 10], [10, 10], "t")) for i in range(100)}) == 100


def test_frames(spark):
    docs = spark.createDataFrame([(1, TEXT, "x"), (None, None, None), (2, "", "y"), (2, "none here 12", "y")], "doc_id long, text string, pii string")
    got = {r.text for r in pseudonymise_texts(docs, b"replace this key in production").collect()}
    assert {None, "", "none here 12", pseudonymise(TEXT, Feistel(b"replace this key in production"))[0]} == got
    assert pseudonymise_texts(docs.limit(0)).count() == 0


def test_more_notations():
    f = Feistel(b"k")
    upper, mixed = "9233A8EC" * 4 + "0123ABCD", "9233A8ec" * 4
    values = [upper, mixed, "0000000000000018", "12/25/1999", "2024-01-15", "+15551234567", "+4930123456789", "+1 5551234567"]
    text = f'TOKEN = "{upper}" {mixed}, 0000000000000018. 12/25/1999 2024-01-15T10:00:00Z +15551234567, +4930123456789, +1 5551234567.'
    new, spans = pseudonymise(text, f)
    assert [k for k, _, _ in spans] == ["secret", "secret", "card", "date", "date", "phone", "phone", "phone"]
    got = [new[a:b] for _, a, b in spans]
    assert all(g != v and len(g) == len(v) for g, v in zip(got, values, strict=True))
    assert re.fullmatch("[0-9A-F]{40}", got[0]) and re.fullmatch("[0-9A-Fa-f]{32}", got[1])
    assert got[2][0] == "0" and luhn([int(c) for c in got[2]])
    assert 1 <= int(got[3][:2]) <= 12 < int(got[3][3:5]) and "T10:00:00Z" in new
    assert got[5][:2] == "+1" and got[6][:3] == "+49" and got[5][2:] == got[7][3:]
    assert pseudonymise(new, f, back=True)[0] == text


def test_cards_of_one_digit_but_the_last_stay_apart():
    f = Feistel(b"k")
    text = "1111111111111117"
    new, spans = pseudonymise(text, f)
    assert len(spans) == 1 and new != text and pseudonymise(new, f, back=True)[0] == text


def test_adjacent_values():
    f, card, es = Feistel(b"k"), "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    cases = {
        f"{card} 123": [("card", card)],
        f"{card} 12/25": [("card", card)],
        f"1234 {card}": [("card", card)],
        "555-123-4567 555-987-6543": [("phone", "555-123-4567"), ("phone", "555-987-6543")],
        f"{es} PAY NOW": [("iban", es)],
        f"{es} 2024": [("iban", es)],
        "DE89370400440532013000 EUR": [("iban", "DE89370400440532013000")],
        f"AB12 CDEF 1234 {card}": [("card", card)],
        f"+49 30 1234 5678 {card}": [("phone", "+49 30 1234 5678"), ("card", card)],
        f"000-12-3456 {card}": [("card", card)],
    }
    for n in range(12):
        cases[f"555-12{n % 10}-4567 555-98{n // 2}-6543"] = [("phone", f"555-12{n % 10}-4567"), ("phone", f"555-98{n // 2}-6543")]
    for text, values in cases.items():
        new, spans = pseudonymise(text, f)
        assert [k for k, _, _ in spans] == [k for k, _ in values], text
        assert [restored(new[a:b], [(k, 0, b - a)], f) for k, a, b in spans] == [v for _, v in values], text
        assert restored(new, spans, f) == text and all(v not in new for _, v in values)


def test_keys(spark):
    docs = spark.createDataFrame([(1, "card 4785380592391139"), (2, "card 4785380592391139")], "doc_id long, text string")
    one, other = ({r.text for r in pseudonymise_texts(docs).collect()} for _ in range(2))
    assert len(one) == len(other) == 1 and one != other and docs.first().text not in one
    assert pseudonymise("x " * 200_000 + "card 4785380592391139", Feistel(b"k"))[1][0][0] == "card"
