"""Fixed rule tables of search: topics, co-retrieval, what general questions leave out, and words of situations."""

# Topics, the words that tell them and the documents that they add.
TOPIC_RULES = [
    ("uy_quyen_quyet_toan", ["ủy quyền quyết toán", "uy quyen quyet toan", "ủy quyền để quyết toán", "uỷ quyền quyết toán"], ["373_2025_NDCP"]),
    (
        "quyet_toan_tncn",
        ["quyết toán thuế", "quyết toán tncn", "quyết toán thu nhập cá nhân", "nộp quyết toán", "hồ sơ quyết toán", "tự quyết toán"],
        ["126_2020_NDCP", "108_2025_QH15"],
    ),
    (
        "xu_phat_hoa_don_125",
        ["mức phạt hóa đơn", "phạt không xuất hóa đơn", "phạt không lập hóa đơn", "xử phạt hóa đơn", "vi phạm hóa đơn", "không xuất hóa đơn bị phạt", "cố tình không xuất hóa đơn"],
        ["125_2020_NDCP"],
    ),
    (
        "hkd_mau_bieu_tt18",
        [
            "18/2026", "tt18", "mẫu s2b", "s2b-hkd", "mẫu kê khai hộ kinh doanh", "tài khoản ngân hàng", "thông báo số tài khoản",
            "01/bk-stk", "bk-stk", "tài khoản cá nhân chủ hộ", "khai theo tháng", "khai theo quý", "sai kỳ khai", "đại lý thuế", "ủy quyền thủ tục thuế",
        ],
        ["18_2026_TTBTC"],
    ),
    (
        "pit_new_law_109",
        [
            "lãi tiết kiệm", "lãi ngân hàng", "lãi suất tiết kiệm", "thu nhập miễn thuế", "được miễn thuế tncn", "giảm trừ gia cảnh", "15,5 triệu", "15.5 triệu",
            "người phụ thuộc 6,2", "người phụ thuộc 6.2", "luật 109", "luật thuế tncn 2025", "từ 01/07/2026", "hiệu lực 2026",
        ],
        ["109_2025_QH15"],
    ),
    (
        "hkd_procedure_68",
        [
            "kỳ khai thuế", "đổi kỳ khai", "khai theo tháng", "khai theo quý", "ủy quyền hoàn thuế", "đại lý thuế làm thay", "hoàn thuế hộ kinh doanh",
            "hoa hồng bảo hiểm", "đại lý bảo hiểm", "hộ kinh doanh hoàn thuế", "68/2026", "nd68",
        ],
        ["68_2026_NDCP"],
    ),
    (
        "tmdt_san_khautru_68",
        [
            "trừ lố", "trừ thừa tiền thuế", "sàn tmđt tính thuế", "thực hiện khấu trừ thuế", "sàn khấu trừ thuế", "sàn thương mại điện tử khấu trừ",
            "01-1/bk", "chủ quản sàn", "chủ quản nền tảng", "xe công nghệ",
        ],
        ["68_2026_NDCP"],
    ),
    ("tmdt_hoan_thue_117", ["trừ lố", "trừ thừa tiền thuế", "hoàn thuế sàn tmđt", "hoàn thuế thương mại điện tử", "sàn tmđt hoàn", "hoàn lại tiền thuế sàn"], ["117_2025_NDCP"]),
    ("ttdb_hkd_373", ["tiêu thụ đặc biệt", "thuế ttđb", "vũ trường", "karaoke", "01/ttđb", "mẫu ttđb"], ["68_2026_NDCP", "373_2025_NDCP"]),
    ("khoi_nghiep_sang_tao_198", ["khởi nghiệp sáng tạo", "doanh nghiệp đổi mới sáng tạo", "startup sáng tạo", "đổi mới sáng tạo", "198/2025", "luật 198"], ["198_2025_QH15"]),
]

# Words of penalties, account books, late payment and authorisation.
PENALTY_WORDS = [
    "phạt", "xử phạt", "vi phạm", "mức phạt", "bị phạt", "tiền phạt", "chế tài", "vi phạm hành chính",
    "310", "nd310", "nđ310", "trốn thuế", "khai sai bị", "chậm nộp", "0,03%", "0.03%", "lãi chậm",
]
ACCOUNTING_WORDS = [
    "sổ kế toán", "sổ doanh thu", "sổ chi tiết", "s1a", "s2a", "s2b", "s2c", "s2d", "s2e", "s3a",
    "s1a-hkd", "s2a-hkd", "s2b-hkd", "s2c-hkd", "s2d-hkd", "s2e-hkd", "mẫu sổ", "phương pháp ghi sổ", "ghi sổ",
    "152/2025", "thông tư 152", "kế toán hộ kinh doanh", "kế toán cá nhân kinh doanh", "lưu trữ sổ", "bảo quản sổ",
]
LATE_WORDS = ["tiền chậm nộp", "lãi chậm nộp", "mức chậm nộp", "chậm nộp thuế", "tính tiền chậm", "0,03%", "0.03%"]
AUTHORISE_WORDS = ["ủy quyền", "uỷ quyền", "quyết toán thay", "ủy quyền quyết toán", "được ủy quyền", "ủy quyền cho", "uỷ quyền cho"]

# The document that only questions of penalties find, and the bounds of how many results are asked for.
PENALTY_ONLY, FEWEST, MOST = "310_2025_NDCP", 1, 10

# What a search within a document (none: a general one) also looks up: filter, words, target, how many, place, turn.
CO_RULES = [
    ("125_2020_NDCP", PENALTY_WORDS, "310_2025_NDCP", 2, "prepend", 0),
    ("125_2020_NDCP", PENALTY_WORDS, "68_2026_NDCP", 2, "prepend", 1),
    (None, LATE_WORDS, "108_2025_QH15", 2, "prepend", 2),
    ("125_2020_NDCP", LATE_WORDS, "108_2025_QH15", 2, "prepend", 2),
    ("310_2025_NDCP", LATE_WORDS, "108_2025_QH15", 2, "prepend", 2),
    ("68_2026_NDCP", ACCOUNTING_WORDS, "152_2025_TTBTC", 3, "append", 3),
    ("117_2025_NDCP", [], "68_2026_NDCP", 3, "append", 4),
    ("126_2020_NDCP", AUTHORISE_WORDS, "373_2025_NDCP", 3, "append", 5),
    ("111_2013_TTBTC", [], "86_2024_TTBTC", 3, "append", 6),
]
CO_SCHEMA = "when_filter string, keywords array<string>, target string, k int, place string, turn int"

# Words of wages, business and online trade.
SALARY_WORDS = [
    "lương", "tiền lương", "tiền công", "thu nhập từ lương", "thu nhập từ tiền lương", "hợp đồng lao động", "người lao động", "làm công", "làm thuê",
    "nhân viên", "nhân công", "công ty trả", "cơ quan trả",
]
BUSINESS_WORDS = [
    "hộ kinh doanh", "hkd", "kinh doanh", "cá nhân kinh doanh", "doanh thu", "bán hàng", "buôn bán", "mở cửa hàng", "cửa hàng",
    "shop", "tiệm", "thu nhập kinh doanh",
]
ONLINE_WORDS = [
    "shopee", "lazada", "tiktok", "tiki", "sendo", "sendo.vn", "sàn tmđt", "sàn thương mại điện tử", "thương mại điện tử",
    "bán online", "bán qua sàn", "bán trên sàn", "bán hàng online", "kinh doanh online", "tmđt", "tme",
]


def topic_rows() -> list[tuple[str, str, str]]:
    """(rule, keyword, doc_id) for each word and document of the topics."""
    return [(name, word, doc) for name, words, docs in TOPIC_RULES for word in words for doc in docs]
