from aktarium.llm import pii


def test_codes_before_other_upper_case_words():
    codes = {"IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB": "ES91 2100 0418 4502 0005 1332", "IBAN AT611904300234573201 BIC": "AT611904300234573201", "BE68 5390 0754 7034 EUR 100": "BE68 5390 0754 7034", "XX99 AB12 DE89 3704 0044 0532 0130 00 OK": "DE89 3704 0044 0532 0130 00"}
    for text, code in codes.items():
        assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "iban"] == [code], text
    assert not [s for s in pii.find_spans("ES92 2100 0418 4502 0005 1332 BIC") if s.kind == "iban"]
