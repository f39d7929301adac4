"""Surrogates where the first space is too small, and in other scripts."""

from tidewater.llm import pii


def test_surrogates_always_found(spark):
    """More two-letter addresses at a host than two-letter local parts, and one name in Chinese at two hosts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    e = [("email", f"{a}{b}@company.tld") for a in letters for b in letters] + [("email", f"{a}{b}@firm{k}.tld") for k in range(13) for a in letters for b in "x"]
    e += [("email", "王伟@b.org"), ("email", "王伟@c.org"), ("email", "_@b.org"), ("email", "_@c.org")]
    assert len(set(e)) > 1000
    got = pii.surrogates(spark.createDataFrame(e, "kind string, entity string"), "k").collect()
    assert len(got) == len(e) == len({r.surrogate for r in got}) and not {r.surrogate for r in got} & {x for _, x in e}
    assert all(pii.find(r.surrogate) == [(0, len(r.surrogate), "email", r.surrogate)] for r in got)
    assert not any("王伟" in r.surrogate for r in got)


def test_other_scripts():
    for kind, entity in [("email", "łčşё@b.org"), ("email", "王小明@b.org"), ("email", "محمد@b.org"), ("email", "דניאל@b.org"), ("ssn", "١٢٣-٤٥-٦٧٨٩"), ("phone", "+49 १२३ ४५६७ ८९०१")]:
        new = pii.surrogate(kind, entity, b"key")
        at = (entity.index("@") if kind == "email" else len(entity))
        kept = [a == b for a, b in zip(entity[:at], new[:at]) if a.isalnum()]
        assert sum(kept) < len(kept) / 2 or kind == "phone" and sum(kept) < len(kept)
        assert pii.find(new) == [(0, len(new), kind, new)]


def test_other_digits_in_texts(spark):
    x = spark.createDataFrame([(1, "call ١٢٣-٤٥-٦٧٨٩ now"), (2, "no data")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(x).collect()}
    assert got[1]["__n"] == 1 and "٦٧٨٩" not in got[1].text and got[2].text == "no data"


def test_later_tries_widen_every_kind():
    for kind, entity in [("ip", "1.2.3.4"), ("ssn", "123-45-6789"), ("phone", "12 345 67"), ("name", "m:Smith")]:
        assert len(pii.surrogate(kind, entity, b"k", 40)) > len(pii.surrogate(kind, entity, b"k", 20)) > 0
