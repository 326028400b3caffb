"""Surrogates keep type, validity, gender and script, agree across texts and stay distinct."""

import random
import re

from pyspark.sql import functions as F

from vigilog.llm import pii


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return sum(c if i % 2 == 0 else c * 2 // 10 + c * 2 % 10 for i, c in enumerate(d)) % 10


def iban_rest(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


ROWS = [
    (1, "Mr John Smith wrote; Mr Smith paid with 3782 822463 10005 and 4111-1111-1111-1111."),
    (2, "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 and fe80::1ff."),
    (3, "Mrs Anna Maria Braun met Г-н Иванов at 12:30:45, see DE89370400440532013000 again."),
    (4, None), (5, ""), (None, "nothing at all " * 3000), (1, "Mr Smith"),
]


def test_types_formats_and_coreference(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = {(r.doc_id, r.n_entities): r.text for r in pii.replace_entities(df, key="k").collect()}
    assert len(found) == len(ROWS) and found[4, 0] is None and found[5, 0] == "" and found[None, 0] == "nothing at all " * 3000
    one, two, three = found[1, 4], found[2, 4], found[3, 3]
    m = re.fullmatch(r"Mr (\w+) (\w+) wrote; Mr (\w+) paid with (\d{4} \d{6} \d{5}) and (\d{4}-\d{4}-\d{4}-\d{4})\.", one)
    assert m and m[2] == m[3] != "Smith" and luhn(m[4]) == luhn("378282246310005") and luhn(m[5]) == 0 and m[4][0] == "3" and m[5][0] == "4"
    assert found[1, 1] == f"Mr {m[3]}"
    n = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) or (GB\d\d[A-Z]{4}\d{14}), host ((?:[0-9a-f]{4}:){7}[0-9a-f]{4}) and ([0-9a-f]{4}::[0-9a-f]{3})\.", two)
    assert n and iban_rest(n[1]) == iban_rest(n[2]) == 1 and n[1] != "DE89 3704 0044 0532 0130 00" and not n[3].startswith("2001")
    assert re.fullmatch(rf"Mrs \w+ \w+ \w+ met Г-н [А-Яа-я]+ at 12:30:45, see {n[1].replace(' ', '')} again\.", three) and "Braun" not in three


def test_many_names_stay_distinct(spark):
    draw = random.Random(1)
    names = list({"".join(draw.choice("abcdefghij") for _ in range(6)).title() for _ in range(3000)})
    df = spark.createDataFrame([(i, f"Mr {x}") for i, x in enumerate(names)], "doc_id long, text string")
    made = pii.replace_entities(df, key="k")
    assert made.select("text").distinct().count() == len(names)
    assert made.join(df, "text").count() == 0 and made.filter(F.col("n_entities") != 1).count() == 0


def test_one_phone_in_all_formats_and_one_name_under_all_titles(spark):
    import re

    phones = ["+1 555 123 4567", "+15551234567", "(555) 123-4567", "555-123-4567", "+1 (555) 123-4567"]
    other = ["+44 20 7946 0958", "+442079460958", "+352 621 123 456", "+352621123456"]
    names = ["Dr Anna Schmidt", "Frau Anna Schmidt", "Prof Anna Weber", "Herr Karl Weber"]
    texts = [f"Call {p} now" for p in phones + other] + [f"Ask {n} today" for n in names]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in pii.replace_entities(df, "key").orderBy("doc_id").collect()]
    digits = [re.sub(r"\D", "", t) for t in new]
    national = digits[2]
    assert digits[:5] == ["1" + national, "1" + national, national, national, "1" + national] and national != "5551234567"
    assert digits[5] == digits[6] != "442079460958" and digits[5].startswith("44") and digits[7] == digits[8] and digits[7].startswith("352")
    for old, made in zip(texts, new, strict=True):
        assert re.sub(r"[\w]", "x", old) == re.sub(r"[\w]", "x", made) or "Ask" in old
    first = [t.split()[2] for t in new[9:]]
    last = [t.split()[3] for t in new[9:]]
    assert first[0] == first[1] == first[2] != "Anna" and last[0] == last[1] and last[2] == last[3] and first[3] != first[0]
