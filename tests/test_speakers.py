import json

import pytest

from rostra import speakers

BIO = {"name": "John Smith", "date_of_birth": "1850-00-00", "party_affiliation": [{"party": "Lab", "start_year": 1890}], "education": {"universities": ["Ox"]}, "political_career": {"first_elected": "1890", "ministerial_positions": ["A", "B"]}, "constituencies": [{"seat": "Ox", "start": "1890"}]}
ASKED = []


def backend(prompt):
    ASKED.append(prompt)
    asked = json.loads(prompt)
    return {"text": json.dumps(BIO) if "smith" in asked["canonical_name"] else ""}


def test_the_pipeline_from_transcripts_to_tables(spark, tmp_path, capsys):
    said = [{"speaker": s, "speaker_url": u, "text": "x"} for s, u in (("Mr. John Smith", None), ("john smith said", ""), ("Mr. Page", "/p"), ("Lady Ann Ox", None), (" ", None))]
    (tmp_path / "t.jsonl").write_text(json.dumps({"day": "1900-01-01", "data": {"chambers": {"c": [{"title": "A", "content": said}]}}}) + "\n")
    (tmp_path / "parties.json").write_text(json.dumps({"Lab": "Labour"}))
    (tmp_path / "given.json").write_text(json.dumps({"ann": "female"}))
    words = ["--transcripts", str(tmp_path / "t.jsonl"), "--work", str(tmp_path / "w"), "--backend", f"{__name__}:backend", "--parties", str(tmp_path / "parties.json"), "--given", str(tmp_path / "given.json")]
    with pytest.raises(SystemExit):
        speakers.main(["research", *words[:4]])
    speakers.main(["all", *words])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"rows": 3, "with_bio": 3, "people": 2, "people_with_bio": 2}
    read = lambda name: spark.read.parquet(str(tmp_path / "w" / name))
    assert {(r["canonical_name"], r["n_rows"]) for r in read("cluster").collect()} == {("john smith", 2), ("ann ox", 1)}
    assert {tuple(r) for r in read("parties").collect()} == {(n, "Labour", 1890, None) for n in ("Mr. John Smith", "john smith said", "mr. john smith")}
    bios = {r["name_from_transcript"]: r for r in read("bios").collect()}
    assert set(bios) == {"Mr. John Smith", "john smith said"}
    assert bios["Mr. John Smith"]["date_of_birth"] == "1850-01-01" and bios["john smith said"]["ministerial_positions"] == "A; B"
    assert {(r["level"], r["institution"]) for r in read("education").collect()} == {("university", "Ox")} and read("constituencies").count() == 3
    assert {tuple(r) for r in read("gender").collect()} == {("Mr. John Smith", None), ("john smith said", None), ("Lady Ann Ox", "female")}
    # Research asks again only for what it has not got.
    before = {r["person_id"]: r["bio"] for r in read("research").collect()}
    speakers.main(["research", *words])
    assert {r["person_id"]: r["bio"] for r in read("research").collect()} == before and sum(b != "" for b in before.values()) == 1
