"""Word lists, patterns and parameters that results depend on."""

from __future__ import annotations

# Fixed values. Cognitive levels, inference strategies, conditions, in order.
LEVELS = ["Remember", "Understand", "Apply", "Analyze", "Evaluate", "Create"]
STRATEGIES = ["standard", "few_shot", "cot", "self_consistency"]
CONDITIONS = ["none_context", "with_context"]
CRITIQUE_DIMENSIONS = ["bloom_alignment", "factual_grounding", "distractor_quality", "question_clarity", "legal_accuracy"]
MODES = {"single_pass": 0, "fixed_2": 2, "fixed_3": 3, "adaptive": 3}

# Fixed values. Metadata keywords of the extraction filter (matched as written) and of the preparation filter (upper-cased).
EXTRACT_KEYWORDS = ["NHÀ XUẤT BẢN", "Chủ biên", "GIÁO TRÌNH", "HỌC VIỆN", "TRƯỜNG ĐẠI HỌC", "ISBN"]
PREPARE_KEYWORDS = ["NHÀ XUẤT BẢN", "Chủ biên", "GIÁO TRÌNH", "HỌC VIỆN", "TRƯỜNG ĐẠI HỌC", "TÁC GIẢ", "BAN BIÊN SOẠN", "MỤC LỤC", "TABLE OF CONTENTS", "ISBN", "Lưu hành nội bộ"]

# Fixed values. Domains by substring of a lower-cased file name, first group wins.
DOMAIN_KEYWORDS = [
    ("hinh_su", ["hinh_su", "hinh su", "hình sự", "toi pham", "tội phạm"]),
    ("hanh_chinh", ["hanh_chinh", "hanh chinh", "hành chính", "to tung hanh"]),
    ("dan_su", ["dan_su", "dan su", "dân sự", "hon nhan", "hôn nhân", "thua ke", "thừa kế", "hop dong", "hợp đồng"]),
]
# Fixed values. Source categories by substring of a path.
SOURCE_KEYWORDS = [("institute_textbook", ["institute"]), ("university_textbook", ["fdvn"]), ("reference_book", ["archive_org"])]

# Fixed values. Starts of a section: marks, then headings of a part, chapter, section, sub-section or article.
SECTION_STARTS = [r"#{1,3}\s+", r"(?:PHẦN|Phần)\s+(?:THỨ\s+)?\w+", r"(?:CHƯƠNG|Chương)\s+[IVXLCDM\d]+", r"(?:MỤC|Mục)\s+\d+", r"(?:TIỂU MỤC|Tiểu mục)\s+\d+", r"(?:Điều|ĐIỀU)\s+\d+[.:]"]

# Fixed values. Phrases of a level, hardest level first; a space stands for any white space.
LEVEL_PHRASES = [
    ("Create", ["soạn thảo", "đề xuất", "thiết kế", "xây dựng (?:phương|quy)", "hãy viết", "hãy lập", "tạo ra", "đưa ra giải pháp"]),
    ("Evaluate", ["đánh giá", "nhận xét", "có hợp lý", "phản biện", "có đúng không", "bạn (?:đồng ý|nghĩ sao)", "chứng minh", "lập luận", "biện minh"]),
    ("Analyze", ["so sánh", "phân biệt", "phân tích", "mối quan hệ", "điểm (?:giống|khác)", "nguyên nhân", "hệ quả", "tại sao (?:lại|có)", "(?:giống|khác) nhau"]),
    ("Apply", ["trong tình huống", "(?:anh|chị|ông|bà|A|B) (?:muốn|đã|cần)", "áp dụng (?:điều|quy)", "giải quyết (?:vụ|tình)", r"(?:nếu|khi) [^\n]*?thì (?:phải|cần|được)", "xử lý (?:như|thế)"]),
    ("Understand", ["giải thích", "nêu ý nghĩa", "tóm tắt", "diễn giải", "hiểu (?:như thế nào|thế nào)", "(?:có nghĩa|nghĩa) là", "trình bày", "mô tả"]),
    ("Remember", ["theo (?:điều|khoản|luật)", "(?:ai|cơ quan nào) có thẩm quyền", "khi nào", "(?:bao gồm|gồm (?:có|những))", "(?:quy định|điều kiện) (?:nào|gì)", "(?:liệt kê|nêu (?:tên|các))", "là gì"]),
]
