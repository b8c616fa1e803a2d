"""Fixed rule tables of the domain: keywords, scopes, rates and brackets.

Everything here is data; the operators read it as small tables or literals.
"""

# Scopes, the documents that belong to them, and the words that point to them.
SCOPE_DOCS = {
    "PIT": ["109_2025_QH15", "110_2025_UBTVQH15", "149_2025_QH15", "108_2025_QH15", "126_2020_NDCP", "1296_CTNVT"],
    "HKD": ["117_2025_NDCP", "68_2026_NDCP", "152_2025_TTBTC", "18_2026_TTBTC", "So_Tay_HKD"],
    "TMDT": ["68_2026_NDCP", "117_2025_NDCP"],
    "PENALTY": ["125_2020_NDCP", "373_2025_NDCP", "310_2025_NDCP"],
}
SCOPE_WORDS = {
    "PIT": [
        "tncn", "thu nhập cá nhân", "giảm trừ gia cảnh", "người phụ thuộc",
        "cá nhân cư trú", "cá nhân không cư trú", "quyết toán thuế",
        "khấu trừ thuế tại nguồn", "biểu thuế lũy tiến", "thuế suất lũy tiến",
        "thu nhập từ tiền lương", "thu nhập từ tiền công", "thu nhập chịu thuế",
        "miễn thuế tncn", "hoàn thuế tncn", "ủy quyền quyết toán",
        "lương", "lương net", "lương gross", "thưởng", "thử việc",
        "hợp đồng thời vụ", "thu nhập từ lương", "đóng thuế thu nhập",
    ],
    "HKD": [
        "hộ kinh doanh", "thuế khoán", "nộp thuế theo khoán",
        "đăng ký kinh doanh hộ", "doanh thu từ kinh doanh",
        "phương pháp khoán", "hộ gia đình kinh doanh",
        "doanh thu trừ chi phí", "nộp thuế theo lợi nhuận",
        "tính thuế theo lợi nhuận", "phương pháp lợi nhuận",
        "kê khai theo doanh thu thực tế", "chế độ kế toán hộ",
        "cho thuê nhà", "cho thuê tài sản", "cho thuê mặt bằng",
        "cho thuê phòng", "cho thuê nguyên căn", "thu nhập từ cho thuê",
        "cho thuê bất động sản",
        "mở tiệm", "mở quán", "tạp hóa", "chạy grab", "xe ôm công nghệ",
        "làm nail", "buôn bán nhỏ", "kinh doanh nhỏ lẻ", "bán lẻ",
        "tiệm", "quán", "cửa hàng nhỏ", "bán hàng", "hkd",
        "tiệm vàng", "tiệm cà phê", "tiệm tóc", "sạp hàng",
        "cửa hàng", "ki ốt", "kinh doanh cá nhân",
    ],
    "TMDT": [
        "shopee", "lazada", "tiktok", "tiki", "sendo", "facebook shop",
        "zalo shop", "grab food", "baemin", "gojek",
        "sàn thương mại điện tử", "bán online", "bán qua sàn",
        "thương mại điện tử", "tmđt", "kinh doanh online",
        "livestream bán hàng", "dropship", "affiliate",
        "sàn giao dịch trực tuyến",
    ],
    "PENALTY": [
        "xử phạt vi phạm", "vi phạm hành chính", "truy thu thuế",
        "cưỡng chế thuế", "mức phạt", "chế tài thuế",
        "hành vi trốn thuế", "khai sai thuế", "chậm nộp",
        "bị phạt", "phạt tiền", "nộp chậm", "quá hạn nộp",
        "trốn thuế", "phạt bao nhiêu", "mức phạt là",
    ],
}
SCOPE_GATE, SCOPE_CALC_CONFIDENCE = 0.4, 0.45

# Patterns that tell what a question wants.
ARTICLE = r"(?iu)(?:điều|khoản|điểm)\s+\d+[a-zđ]?"
DOC_NUMBER = r"(?iu)\d{1,4}[/\-]\d{4}[/\-][A-ZĐ\-]{2,20}"
ASKS_VALIDITY = r"(?iu)còn hiệu lực|đã hết hiệu lực|hiện (nay|tại|đang)|có còn áp dụng|còn áp dụng|thời điểm|khi nào có hiệu lực"
ASKS_CROSS = r"(?iu)văn bản nào|nghị định nào|thông tư nào|hướng dẫn (luật|nghị định)|quy định tại|theo (luật|nghị định|thông tư)|sửa đổi|thay thế|bãi bỏ|ban hành kèm"
ASKS_SUM = r"(?iu)tính (thuế|thu nhập|khấu trừ|giảm trừ)|bao nhiêu tiền|phải nộp|thuế phải trả|lương\s+\d|thu nhập\s+\d|\d+\s*(triệu|nghìn|đồng)"
ARTICLE_ONLY = r"(?iu)^(?:cho tôi biết\s+)?điều\s+\d+[a-zđ]?\s*(?:(?:luật|NĐ|TT|QH)\s+[\d/\-A-Z]+)?[?.]?\s*$"
TAX_ANCHOR = (
    r"(?iu)thuế|tncn|hkd|hộ kinh doanh|kê khai|quyết toán|hoàn thuế|miễn thuế"
    r"|hóa đơn|nghị định|thông tư|luật|điều\s+\d|khoản\s+\d"
    r"|doanh thu|thu nhập|giảm trừ|người phụ thuộc|lương|tiền công"
    r"|phạt|vi phạm|truy thu|cưỡng chế|sàn tmđt|shopee|lazada|tiktok"
    r"|gtgt|vat|bhxh|bhyt|bhtn|cnkd|cá nhân kinh doanh|hộ khoán"
    r"|mẫu\s+\d+|tờ khai|thủ tục|hồ sơ thuế"
)
OFF_DOMAIN = (
    r"(?iu)thời tiết|bóng đá|nấu ăn|công thức|tình yêu|chứng khoán|bitcoin"
    r"|crypto|game|phim|âm nhạc|thể thao|y tế|sức khỏe|bệnh viện"
    r"|trường học|giáo dục|ngoại ngữ|du lịch|khách sạn|nhà hàng"
)

# Who speaks and of which tax, by priority, and words that go on from before.
ENTITIES = {
    "HKD": ["hộ kinh doanh", "hkd", "hộ cá thể", "kinh doanh hộ", "cơ sở kinh doanh", "hộ buôn bán"],
    "CNKD": ["cá nhân kinh doanh", "cnkd", "cá nhân có thu nhập kinh doanh", "bán hàng online", "buôn bán online", "kinh doanh online"],
    "enterprise": ["doanh nghiệp", "công ty", "tnhh", "cổ phần", "tập đoàn"],
    "individual": ["tôi", "mình", "nhân viên", "người lao động", "người làm công", "cá nhân", "người có thu nhập", "cá nhân cư trú"],
}
TAXES = {
    "TMDT": ["tmđt", "thương mại điện tử", "sàn tmđt", "shopee", "tiktok shop", "lazada", "sàn khai thay", "sàn khấu trừ", "bán hàng online"],
    "HKD_TAX": ["thuế khoán", "thuế hộ kinh doanh", "thuế môn bài", "lệ phí môn bài", "thuế hộ", "nd68", "68/2026", "khai thuế theo tháng", "khai thuế theo quý"],
    "Penalty": ["xử phạt", "phạt vi phạm", "chế tài", "tiền phạt", "vi phạm hành chính", "thanh tra", "kiểm tra thuế"],
    "TNCN": ["tncn", "thu nhập cá nhân", "thuế thu nhập", "lương", "tiền lương", "giảm trừ gia cảnh", "người phụ thuộc", "khấu trừ tại nguồn", "quyết toán thuế", "khởi điểm chịu thuế"],
    "GTGT": ["gtgt", "giá trị gia tăng", "vat", "ngưỡng 100 triệu", "thuế đầu ra", "thuế đầu vào"],
}
CONTINUES = [
    "ngoài ra", "còn", "thêm nữa", "bên cạnh đó", "thêm", "cũng", "như vậy", "vậy thì", "vậy", "ở trường hợp đó",
    "trường hợp đó", "trường hợp này", "trường hợp trên", "ý tôi là", "cụ thể hơn", "chi tiết hơn",
    "trên", "đó", "câu hỏi trước", "ví dụ trên",
]

# Rates, brackets and thresholds (VND).
VAT_RATES = {"goods": 0.01, "services": 0.05, "manufacturing": 0.03, "other": 0.02, "real_estate": 0.05}
PIT_RATES = {"goods": 0.005, "services": 0.02, "manufacturing": 0.015, "other": 0.01, "real_estate": 0.05}
PROFIT_BRACKETS = [(0.0, 5e8, 0.0), (5e8, 3e9, 0.15), (3e9, 5e10, 0.17), (5e10, None, 0.20)]
INCOME_BRACKETS = [(0.0, 1.2e8, 0.05), (1.2e8, 3.6e8, 0.10), (3.6e8, 7.2e8, 0.20), (7.2e8, 1.2e9, 0.30), (1.2e9, None, 0.35)]
# the monthly scale of the former law, which no calculator uses
MONTHLY_BRACKETS = [(0.0, 5e6, 0.05), (5e6, 1e7, 0.10), (1e7, 1.8e7, 0.15), (1.8e7, 3.2e7, 0.20), (3.2e7, 5.2e7, 0.25), (5.2e7, 8e7, 0.30), (8e7, None, 0.35)]
SELF_DEDUCTION, DEPENDENT_DEDUCTION = 15_500_000, 6_200_000
OLD_SELF_DEDUCTION, OLD_DEPENDENT_DEDUCTION = 11_000_000, 4_400_000
EXEMPT_UP_TO, PROFIT_FROM, MONTHLY_FROM = 5e8, 3e9, 5e10
EINVOICE_OPTIONAL, EINVOICE_REQUIRED = 5e8, 1e9

# Signs of comparison, by class, and phrases that contradict each other.
COMPARATORS = [
    (">", ["trên", "vượt quá", "quá", "hơn", "lớn hơn"]),
    (">=", ["từ", "ít nhất", "tối thiểu", "không dưới", "đủ", "đạt"]),
    ("<=", ["trở xuống", "không quá", "tối đa", "không vượt quá", "không hơn"]),
    ("<", ["dưới", "chưa đến", "chưa tới", "nhỏ hơn"]),
]
OPPOSITES = {">": ["<", "<="], ">=": ["<"], "<": [">", ">="], "<=": [">"]}
POLARITY = [
    (
        ["miễn thuế", "không phải nộp", "không thuộc diện", "được miễn", "không chịu thuế", "không phải đóng"],
        ["phải nộp", "chịu thuế", "thuộc diện chịu", "có nghĩa vụ nộp", "bắt buộc nộp", "phải đóng thuế"],
    ),
    (["được hoàn", "hoàn thuế", "được hoàn trả", "được hoàn lại"], ["không được hoàn", "không hoàn", "không được hoàn trả"]),
    (["được khấu trừ", "được trừ vào chi phí", "được tính vào chi phí"], ["không được khấu trừ", "không được trừ", "không được tính chi phí"]),
    (["được giảm trừ", "được giảm"], ["không được giảm trừ", "không được giảm"]),
]

# Phrases that make a node an exception of what it refers to; fact patterns.
EXCEPTION = (
    r"(?iu)(?:trừ\s+trường\s+hợp|không\s+áp\s+dụng|ngoại\s+trừ|trường\s+hợp\s+(?:quy\s+định\s+tại|nêu\s+tại)"
    r"|không\s+tính\s+(?:vào\s+)?thu\s+nhập\s+chịu\s+thuế|được\s+miễn\s+(?:thuế|nộp))"
)
FACTS = [
    (r"\d+(?:[.,]\d+)?\s*%", "numeric"),
    (r"(?iu)\d+(?:[.,]\d+)?\s*(?:triệu|tỷ)(?![\p{L}\p{N}])", "numeric"),
    (r"(?iu)\d{1,3}(?:[.,]\d{3})+\s*(?:đồng|VNĐ|VND|₫)?", "numeric"),
    (r"(?iu)\d+\s*(?:ngày|tháng|năm)(?![\p{L}\p{N}])", "numeric"),
    (r"(?iu)(?:điều|khoản|điểm|mục|chương)\s+\d+[a-zđ]?(?:\s+(?:điều|khoản|điểm)\s+\d+[a-zđ]?)*", "citation"),
]

# Fixed value: words that name a household business without doubt; its documents are only added to a search behind them.
HOUSEHOLD_GATE = (
    r"(?iu)hộ kinh doanh|hkd(?![\p{L}\p{N}_])|hộ gia đình kinh doanh|đăng ký kinh doanh hộ|"
    r"thuế khoán|phương pháp khoán|doanh thu trừ chi phí|phương pháp lợi nhuận|"
    r"kê khai theo doanh thu thực tế|chế độ kế toán hộ"
)
# Lines that close an open node, by its level.
CLOSES = {"dieu": ["dieu"], "khoan": ["khoan", "dieu"], "diem": ["diem", "khoan", "dieu"], "tiet": ["tiet", "diem", "khoan", "dieu"]}
