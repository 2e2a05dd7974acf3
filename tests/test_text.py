import random
import re

from pyspark.sql import functions as F

from notalake.functions import text as t
from notalake.operators import extract_text as x


def brute_fixed(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        out.append(text[at : at + size].strip())
        if at + size >= len(text):
            break
        at += size - overlap
    return [c for c in out if c]


def prose(seed, n):
    rng = random.Random(seed)
    parts = []
    for _ in range(n):
        parts.append("".join(rng.choice("abcçé") for _ in range(rng.randrange(1, 12))))
        parts.append(rng.choice([" ", " ", " ", ". ", "! ", "\n\n", "\n", "  "]))
    return "".join(parts)


TEXTS = ["", "curto", " " * 50] + [prose(s, n) for s, n in enumerate([5, 40, 200, 900, 2500])] + ["x" * 3000, prose(99, 400) + "y" * 1500 + ". " + prose(7, 100)]


def test_split_by_hand(value):
    words, paragraphs = "alpha beta gamma delta epsilon zeta", "um dois\n\ntres quatro cinco seis"
    got = [list(c) for c in value(lambda c: t.split_chunks(c, 20, 10), words, paragraphs, "curto", "", "  ")]
    assert got == [
        ["alpha beta gamma", "beta gamma delta", "gamma delta epsilon", "delta epsilon zeta"],
        ["um dois tres quatro", "tres quatro cinco", "quatro cinco seis"],
        ["curto"],
        [],
        [],
    ]


def test_split_keeps_all_words_and_repeats_the_last_ones(value):
    for text, chunks in zip(TEXTS, value(lambda c: t.split_chunks(c, 300, 60), *TEXTS)):
        seen = {w for c in chunks for w in re.findall(r"\w+", c)}
        assert seen == set(re.findall(r"\w+", text))
        for before, after in zip(chunks, chunks[1:]):
            assert after.startswith(" ".join(before.split(" ")[-12:]) + " ")
        longest = max([len(w) for w in text.split(" ")], default=0)
        assert all(len(c) <= max(300, longest) + 12 * (longest + 1) for c in chunks)


def test_sentence_windows_by_hand(value):
    text = "Um dois tres. Quatro cinco seis sete oito nove."
    assert [list(c) for c in value(lambda c: t.sentence_chunks(c, 20, 4, 10), text, "Curto.", "")] == [
        ["Um dois tres.", "res. Quatro cinco se", "o seis sete oito nov", "nove."], ["Curto."], [],
    ]


def test_sentence_windows_cover_the_text(value):
    distinct = [s for s in TEXTS if len(set(s)) != 1]  # a place is looked up by its text
    for text, chunks in zip(distinct, value(lambda c: t.sentence_chunks(c), *distinct)):
        end = 0
        for chunk in chunks:
            start = text.find(chunk, max(0, end - 201))
            assert start >= 0 and not text[end:start].strip() and len(chunk) <= max(1000, len(text) if len(text) <= 1000 else 0)
            end = start + len(chunk)
        assert not text[end:].strip()


def test_fixed_windows_against_brute_force(value):
    assert [list(c) for c in value(lambda c: t.fixed_chunks(c), *TEXTS)] == [brute_fixed(s, 1200, 200) for s in TEXTS]


def test_cut_at_sentence(value):
    texts = ["Curto.", "Um dois. Três quatro! Cinco seis sete"]
    assert value(lambda c: t.cut_at_sentence(c, 22), *texts) == ["Curto.", "Um dois. Três quatro."]


def test_cleaning(value):
    assert value(t.clean_wide, "  Emitida NF-e  nº 5 § do ICMS\n") == ["emitida nota fiscal eletrônica nº 5  do icms"]
    assert value(t.clean_narrow, " nfe do cnpj [x] ") == ["nota fiscal eletrônica do CNPJ x"]
    assert value(t.prefixed_query, "Minha Nota", "oi") == ["contexto fiscal: Minha Nota", "oi"]


def test_type_from_text(value):
    got = value(x.document_type, "<NFCe><infNFe>", '<nfe mod="65">', "NOTA FISCAL ELETRÔNICA", "CT-e 5", "mdf-e", "57" + "1" * 42, "67" + "1" * 42, "oi", "", None)
    assert got == ["nfce", "nfce", "nfe", "cte", "mdfe", "mdfe", "cte", "unknown", "unknown", "unknown"]


def test_labelled_fields(spark):
    raw = "NOTA FISCAL ELETRÔNICA\nCNPJ: 12.345.678/0001-95\nCPF: 123.456.789-09\nNota Nº 987\nData de Emissão: 1/2/2025 10:40\nValor Total R$: 175,50\nICMS: R$ 31,59\nRazão Social: Loja Á"
    df = spark.createDataFrame([(raw,)], "raw_text string")
    r = x.labelled_fields(df).first()
    assert (r["emitente_cnpj"], r["destinatario_cpf"], r["numero"], r["data_emissao"], r["valor_total"], r["emitente_razao_social"]) == (
        "12.345.678/0001-95", "123.456.789-09", "987", "2025-02-01 10:40:00", 175.5, "Loja Á",
    )
    assert df.select(x.text_taxes(F.col("raw_text"))["icms"]).first()[0] == 31.59


def test_loose_lines(spark):
    raw = "NOTA FISCAL\nEmitente 12.345.678/0001-95\nOutro 98.765.432/0001-10\nCliente 123.456.789-09\n123\n01/02/2025\n1x Parafuso 2,00 4,00\nValor Total 10,50\nTotal: 11,00"
    r = x.loose_lines(spark.createDataFrame([(raw,), ("sem nada",), (None,)], "raw_text string")).collect()
    assert (r[0]["tipo_documento"], r[0]["emitente_cnpj"], r[0]["destinatario_doc"], r[0]["numero"], r[0]["data_emissao"], r[0]["total"]) == (
        "NFE", "12345678000195", "12345678909", "123", "01/02/2025", 11.0,
    )
    assert [(i["descricao"], i["quantidade"], i["valor_total"]) for i in r[0]["itens"]] == [("1x Parafuso", 2.0, 4.0)]
    assert [q["tipo_documento"] for q in r[1:]] == ["MDF", "MDF"]


def test_access_key_and_runs(value):
    key = "41230655443322000188650070000345671098765432"
    assert value(x.access_key, " ".join(re.findall("....", key)), "123") == [key, None]
    assert [list(r) for r in value(x.registration_runs, "a 12345678000195 b 11222333000181 c 12345678000195", "")] == [["12345678000195", "11222333000181"], []]
