"""The collection's dimension tables: a row for each regulation, and for each document beside the statutes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from clausewise import schemas

# The regulations, their numbers in the Official Journal's register, and where they are published.
REGULATIONS = (
    ("DORA", "Regulation (EU) 2022/2554 (Digital Operational Resilience Act)", "32022R2554", "en"),
    ("GDPR", "Regulation (EU) 2016/679 (General Data Protection Regulation)", "32016R0679", "en"),
    ("KVKK", "6698 sayılı Kişisel Verilerin Korunması Kanunu", None, "tr"),
    ("BDDK", "BDDK Bilgi Sistemleri Yönetmeliği", None, "tr"),
)
KVKK_URL, BOARD_URL = "https://www.mevzuat.gov.tr/mevzuatmetin/1.5.6698.pdf", "https://www.kvkk.gov.tr/"

# Acts that supplement a regulation and have articles (id, type, year and number, date of adoption).
EU_ACTS = (
    ("DORA-RTS-2024-1772", "rts", "2024/1772", "2024-03-13"),
    ("DORA-RTS-2025-301-incident-reporting-timelines", "rts", "2025/301", None),
    ("DORA-ITS-2025-302-incident-reporting-forms", "its", "2025/302", None),
    ("DORA-RTS-2024-1773-ict-third-party-policy", "rts", "2024/1773", None),
    ("DORA-RTS-2024-1774-ict-risk-management", "rts", "2024/1774", None),
    ("DORA-RTS-2025-1190-TLPT", "rts", "2025/1190", None),
    ("DORA-RTS-2025-295-oversight-conduct", "rts", "2025/295", None),
    ("DORA-RTS-2025-420-joint-examination-teams", "rts", "2025/420", None),
    ("DORA-RTS-2025-532-subcontracting", "rts", "2025/532", None),
    ("DORA-ITS-2024-2956-register-of-information", "its", "2024/2956", None),
)
# All others (id, parser, type, date, in force, label).
OTHERS = (
    ("KVKK-KK-2018-10", "decision", "board_decision", "2018-01-31", True, "Kurul Kararı 2018/10"),
    ("KVKK-KK-2019-10", "decision", "board_decision", "2019-01-24", True, "Kurul Kararı 2019/10"),
    ("KVKK-KK-2019-271", "decision", "board_decision", "2019-09-18", True, "Kurul Kararı 2019/271"),
    ("KVKK-KK-2025-1572", "decision", "board_decision", "2025-09-04", True, "Kurul Kararı 2025/1572"),
    ("KVKK-REHBER-VERI-GUVENLIGI", "decision", "guideline", None, True, "Kişisel Veri Güvenliği Rehberi"),
    ("KVKK-7499-AMENDMENT-NOTES", "decision", "notes", None, True, "7499 Değişiklik Notu (gayriresmi — resmi metin için KVKK madde metnine bakınız)"),
    ("DORA-DR-C2024-896-CTPP-designation-criteria", "articles", "delegated_act_draft", "2024-02-22", True, "Delegated Regulation C(2024) 896 final (adoption text, pre-OJ numbering)"),
    ("DORA-DR-C2024-902-oversight-fees", "articles", "delegated_act_draft", None, True, "Delegated Regulation C(2024) 902 final (adoption text, pre-OJ numbering)"),
    ("DORA-JC-GL-2024-36-oversight-cooperation", "decision", "guideline", "2024-11-06", True, "Joint Guidelines JC/GL/2024/36"),
    ("DORA-JC-2024-34-guidelines-costs-and-losses", "decision", "guideline", None, False, "Guidelines JC 2024 34 (not final as issued)"),
    ("DORA-ESA-2024-22-CTPP-reporting-decision", "decision", "decision", "2024-11-08", True, "ESA Decision 2024/22"),
    ("DORA-EIOPA-BOS-24-425-opinion-solvency-ii-scope", "decision", "opinion", "2024-11-14", True, "EIOPA-BoS-24/425 Opinion"),
)


def regulations(spark: SparkSession) -> DataFrame:
    """One row a regulation; those of the Union are found by their number in the register."""

    def url(name: str, celex: str | None) -> str:
        if celex:
            return f"https://eur-lex.europa.eu/legal-content/EN/TXT/HTML/?uri=CELEX:{celex}"
        return KVKK_URL if name == "KVKK" else ""

    rows = [(name, full, celex, url(name, celex), language) for name, full, celex, language in REGULATIONS]
    return spark.createDataFrame(rows, schemas.REGULATIONS)


def documents(spark: SparkSession) -> DataFrame:
    """One row a document; an act's label and address follow from its type and number."""
    rows = []
    for name, kind, number, day in EU_ACTS:
        delegated = kind == "rts"
        label = f"Commission {'Delegated' if delegated else 'Implementing'} Regulation (EU) {number}"
        place = f"https://eur-lex.europa.eu/eli/reg_{'del' if delegated else 'impl'}/{number}/oj"
        rows.append((name, "DORA", "articles", kind, day and date.fromisoformat(day), True, label, label, place, "en"))
    for name, parser, kind, day, valid, label in OTHERS:
        regulation = name.partition("-")[0]
        turkish = regulation == "KVKK"
        place = BOARD_URL if turkish and kind != "notes" else ""
        rows.append((name, regulation, parser, kind, day and date.fromisoformat(day), valid, label, label, place, "tr" if turkish else "en"))
    return spark.createDataFrame(rows, schemas.DOCUMENTS)
