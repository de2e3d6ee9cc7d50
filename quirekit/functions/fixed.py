"""The character ranges, word lists, tables and limits that results depend on."""

# Whitespace as Python's str.isspace has it, as the inside of a Java character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

# Character ranges.
SYLLABLE = "가-힣"
JAMO = "ᄀ-ᇿ㄰-㆏"
HAN = "一-鿿㐀-䶿"
SYMBOL = r"|\\/\[\]()+\-!<>"
PURE_MARK = SYMBOL + ".,;:"
NOISE = r"=—|\-· \t"

# Wrong and right spellings, in the order of the list.
TYPOS = (
    ("(Lem)", "(LLM)"),
    ("미I", "PII"),
    ("Self-ReflectiveReliability", "Self-Reflective Reliability"),
    ("SafetyProtocols", "Safety Protocols"),
    ("삐'ti-layer", "Multi-layer"),
    ("허깅폐이스깨", "Hugging"),
    ("허깅폐이스깨400!ㅁ09", "Hugging"),
    ("허깅페이스", "Hugging"),
    ("Token'Sㅁ'", "Token"),
    ("접근하는 시는", "접근하는 AI는"),
    ("표순만", "표준안"),
    ("규청", "규정"),
    ("천반", "전반"),
    ("목순", "목적"),
    ("않이", "많이"),
    ("표준만", "표준안"),
    ("개민", "개인"),
    ("파민튜닝", "파인튜닝"),
    ("가줌치", "가중치"),
    ("기먹", "기억"),
    ("먼어", "언어"),
    ("민증", "인증"),
    ("말고리즘", "알고리즘"),
    ("위변소", "위변조"),
    ("블록제민", "블록체인"),
    ("다충", "다중"),
    ("ㄴㄴM", "LLM"),
    ("ㄴㄴ M", "LLM"),
)

# Acronyms of a whole token, and inside parentheses.
TOKEN_ACRONYMS = {"P0II": "PII", "P|I": "PII", "0!!": "PII", "Al": "AI", "LLeMm": "LLM", "LLeM": "LLM", "Llm": "LLM", "Lem": "LLM", "Lemm": "LLM", "ㄴㄴM": "LLM", "Z(LM)": "LLM"}
PAREN_ACRONYMS = {"LLeMm": "LLM", "LLeM": "LLM", "Llm": "LLM", "Lem": "LLM", "Lemm": "LLM"}

# Words of the English domain.
DOMAIN_WORDS = ("LLM", "PII", "AI", "Token", "Hugging", "Face", "Read-Write", "Self-Reflective", "Reliability", "Kill-Switch", "Blockchain", "API")

# Letters that make a short word suspicious.
SUSPICIOUS = "의익폐페"

# Hangul letters by place in a syllable block; a space is "no final".
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
BLOCK = 0xAC00

# Limits and defaults.
DIRECT_WORDS = 10
CHANGE_LIMIT = 0.05
LOG_LETTERS = 200
HIT_LETTERS = 80
CONFIDENCE = 70
DPI = 300
PAGE_MODE = 6
BORDER = 10
PADDING = 8
ASCII_LEAST = 0.5
REPLACEMENTS_MOST = 20
TIMEOUT_S = 120
SHARPEN = 0.55
CLIP = 2.5
TILES = 8
BEST_KOR_MB, BEST_ENG_MB = 10.0, 4.5

# Engine settings of the first recognition.
ENGINE = "--oem 1 --psm 6 -c preserve_interword_spaces=1 -c tessedit_do_invert=0 -c language_model_penalty_non_dict_word=0.25 -c language_model_penalty_non_freq_dict_word=0.2"
MODEL_DIRS = (
    "/usr/share/tesseract-ocr/5/tessdata",
    "/usr/share/tesseract-ocr/4.0/tessdata",
    "/usr/share/tesseract-ocr/4.00/tessdata",
    "/usr/share/tessdata",
    "/usr/local/share/tessdata",
)
MODEL_GLOB = "/usr/share/tesseract-ocr/*/tessdata"
CLASS_LABELS = (("korean", "한글"), ("english", "영어"), ("digit", "숫자"), ("chinese", "한자"))
