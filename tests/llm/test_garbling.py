from strandweave.llm import garbling as G

CLEAN = ["The applicant’s notification of the western café shall be “final” – if need be … as agreed.", "Die nachträgliche Prüfung der Größe wird später veröffentlicht.", "La créance douanière sera prorogée après contrôle.", "คำพิพากษาของคณะกรรมการที่ดินชายน้ำให้เป็นไปตามมาตรา ๑๖ แห่งพระราชบัญญัติ", "Ångström, Æro och Øvre; À DISPOSIÇÃO; “Ã”"]


def garble(text, written, read):
    return text.encode(written, "replace").decode(read, "replace")


def test_undo_restores_what_a_chain_did():
    for n, (written, read, times) in enumerate(G.CHAINS):
        for text in CLEAN[:4]:
            try:
                raw = text
                for _ in range(times):
                    raw = raw.encode(written).decode(read)
            except UnicodeError:
                continue
            assert G.RUN.sub(lambda m, n=n: G.undo(m.group(), n), raw) == text, G.NAMES[n]


def test_affected_records_are_found_and_restored(spark):
    rows = [(i, CLEAN[i % 5], "s") for i in range(200)]
    bad = {1000: (CLEAN[0], "utf-8", "cp1252"), 1001: (CLEAN[3], "cp874", "latin-1"), 1002: (CLEAN[1], "cp1252", "mac_roman"), 1003: (CLEAN[2], "utf-8", "cp437")}
    for k, (t, w, r) in bad.items():
        rows.append((k, t.encode(w, "ignore").decode(r, "ignore") if r != "cp1252" else t.encode(w).decode("latin-1"), "s"))
    rows += [(1004, "lost �character", None), (1005, None, "s"), (1006, "", None)]
    df = spark.createDataFrame(rows, "id long, t string, src string")
    got = {r.id: r for r in G.repaired(df, "id", "t", "src").collect()}
    assert set(got) == {*bad, 1004}
    assert got[1003].repaired == CLEAN[2] and got[1000].repaired == CLEAN[0] and got[1001].repaired == CLEAN[3]
    assert got[1004].lost and got[1004].chain is None


def test_empty_table(spark):
    assert G.garbled(spark.createDataFrame([], "id long, t string, src string"), "id", "t", "src").count() == 0
