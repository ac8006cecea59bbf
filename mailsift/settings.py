"""Typed settings shared by every operator.

The block marked FIXED VALUES holds constants that must equal the behaviour
being reproduced (patterns, tag lists, word lists, thresholds). They are
stated verbatim and in their natural order; everything else in the library
derives from them.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (must stay identical for equal results)
# --------------------------------------------------------------------------

# Language aliases; an unmapped value passes through unchanged.
LANGUAGE_MAP = {
    "cn": "zh-hans",
    "cn-tr": "zh-hant",
    "zh_hans": "zh-hans",
    "zh_hant": "zh-hant",
    "zh": "zh-hans",
}

# Extractor allow-lists used by the fusion step, and the location blacklist.
FUSION_ML_TAGS = [
    "NAME_GIVEN", "NAME_MIDDLE", "NAME_SURNAME", "NAME_PREFIX", "NAME_SUFFIX",
    "JOB_TITLE", "ORGANIZATION", "ADDRESS_STREET", "PHONE_MOBILE",
    "PHONE_OFFICE", "PHONE_HOME", "PHONE_FAX", "ADDRESS_POSTAL_CODE",
]
FUSION_REGEX_TAGS = ["EMAIL", "URL", "LINKEDIN"]
LOCATION_BLACKLIST = [
    "Mobile", "Office", "City", "Fax", "Success", "Management", "County",
    "State", "Home", "Name", "Address", "Street", "Country", "Postal", "Code",
    "Zip", "Point", "Drive", "Court",
]

# Regular expressions (Java syntax accepts them unchanged).
PHONE_PATTERNS = {
    "us": r"((?:\+\d{1,3}[-\.\s]??|\d{4}[-\.\s]??)?(?:\d{3}[-\.\s]??\d{3}[-\.\s]??\d{4}|\(\d{3}\)\s*\d{3}[-\.\s]??\d{4}|\d{3}[-\.\s]??\d{4}))",
    "uk": r"^(\+?44)?(?=(.*?\d){10,})( ?\(\d+\))?[ \d]+(#\d+)?$",
    "ca": r"((?:\+\d{1,3}[-\.\s]??|\d{4}[-\.\s]??)?(?:\d{3}[-\.\s]??\d{3}[-\.\s]??\d{4}|\(\d{3}\)\s*\d{3}[-\.\s]??\d{4}|\d{3}[-\.\s]??\d{4}))",
    "chn": r"(?:\+?86)?1(?:3\d{3}|5[^4\D]\d{2}|8\d{3}|7(?:[0-35-9]\d{2}|4(?:0\d|1[0-2]|9\d))|9[0-35-9]\d{2}|6[2567]\d{2}|4(?:(?:10|4[01])\d{3}|[68]\d{4}|[579]\d{2}))\d{6}$",
}
FAX_PATTERNS = {
    "us": r"(fax:|Fax:|f:|F:|F.|f.|F-|f-|Fax |fax )\s?((?:\+\d{1,3}[-\.\s]??|\d{4}[-\.\s]??)?(?:\d{3}[-\.\s]??\d{3}[-\.\s]??\d{4}|\(\d{3}\)\s*\d{3}[-\.\s]??\d{4}|\d{3}[-\.\s]??\d{4}))",
}
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
WEB_PATTERN = r"((http|https)\:\/\/)?[a-zA-Z0-9\.\/\?\:@\-_=#]+\.([a-zA-Z]){2,6}([a-zA-Z0-9\.\&\/\?\:@\-_=#])*"
LINKEDIN_PATTERN = r"((http(s?)://)*([a-zA-Z0-9\-])*\.|[linkedin])[linkedin/~\-]+\.[a-zA-Z0-9/~\-_,&=\?\.;]+[^\.,\s<]"

# Literal prefixes deleted from URL matches, applied in this order.
URL_PREFIX_REPLACEMENTS = ["w:", "W:", "blog:", "Blog:"]
# Literal markers that disqualify a URL or LinkedIn match.
URL_REJECT_MARKERS = ["@", "malito"]
# The second one is a slip for this word, which never stands without "@" in a match of its own; both are rejected.
URL_REJECT_ALSO = ["mailto"]

# Evaluation tag vocabulary and report layouts.
STANDARD_TAGS = [
    "NAME_PREFIX", "NAME_GIVEN", "NAME_SURNAME", "NAME_MIDDLE", "NAME_SUFFIX",
    "JOB_TITLE", "ORGANIZATION", "ADDRESS_STREET", "ADDRESS_CITY",
    "ADDRESS_COUNTRY_DIVISION", "ADDRESS_COUNTRY", "ADDRESS_POSTAL_CODE",
    "PHONE_EXTENSION", "PHONE_OFFICE", "PHONE_MOBILE", "PHONE_HOME",
    "PHONE_FAX", "PHONE_SOCIAL", "PHONE_VOICE_MAIL", "PHONE_TIE_LINE",
    "PHONE_PAGER", "URL", "EMAIL", "LINKEDIN", "UNKNOWN",
]
FULL_LEADERBOARD_COLUMNS = [
    "MODEL", "TEST_DATASET", "ADDRESS_CITY", "ADDRESS_COUNTRY",
    "ADDRESS_POSTAL_CODE", "ADDRESS_STREET", "EMAIL", "ORGANIZATION", "URL",
    "PHONE_MOBILE", "PHONE_OFFICE", "JOB_TITLE", "NAME_GIVEN", "NAME_SURNAME",
    "LAST_UPDATE", "MODEL_VERSION",
]
STANDARD_EMAIL_DATA = ["email_id", "email_body_text", "signature_block", "signature_block_ner", "NER_id"]
# Rows of the formatted leaderboard, in report order.
LEADERBOARD_ROWS = [
    "ADDRESS_CITY", "ADDRESS_COUNTRY", "ADDRESS_POSTAL_CODE", "ADDRESS_STREET",
    "EMAIL", "ORGANIZATION", "URL", "PHONE_MOBILE", "PHONE_OFFICE",
    "JOB_TITLE", "NAME_GIVEN", "NAME_SURNAME",
]
# Cell values that count as "missing" in gold/prediction tables.
NULL_SENTINELS = ["None", "[]", "NaN", "NAN", "nan", "Null", "null"]
MULTI_VALUE_SEPARATOR = " ; "

# Signature construction and segmentation limits.
INFERENCE_TOKEN_LIMIT = 400
TRAINING_TOKEN_LIMIT = 250
DIRECT_EXTRACTOR_MAX_TOKENS = 512
# Training windows are multiples 0.1 .. 0.6 of the maximum segment size.
TRAINING_LIMIT_FRACTIONS = (1, 7, 1)  # range(int(0.1*m), int(0.7*m), int(0.1*m))
SIGNATURE_LABEL = "SIGNATURE"
BODY_LABEL = "BODY"
# Post-filter of fused entities.
PHONE_TAGS = ["PHONE_MOBILE", "PHONE_OFFICE", "PHONE_HOME", "PHONE_FAX"]
PHONE_MIN_DIGITS_EXCLUSIVE = 8
NAME_OR_ORG_TAGS = ["NAME_GIVEN", "NAME_MIDDLE", "NAME_SURNAME", "ORGANIZATION"]
GAZETTEER_TAG = {"city": "ADDRESS_CITY", "state": "ADDRESS_COUNTRY_DIVISION", "country": "ADDRESS_COUNTRY"}
# Response enums.
PARSE_SUCCESS = "SUCCESS"
PARSE_NO_SIGNATURE = "NO_SIGNATURE_BLOCK"
SENDER_CONFIDENCE = 5
SPLIT_NAMES = ["train", "validation", "test"]
# Few-shot prompt label words per language.
PROMPT_KEYS = {
    "en": {"TEXT": "TEXT", "TASK": "TASK", "EXAMPLES": "EXAMPLES"},
    "zhs": {"TEXT": "文本", "TASK": "任务", "EXAMPLES": "例子"},
}
# Characters of one Chinese script that the other writes differently, in matching order.
SIMPLIFIED_ONLY = "们这国学说时会对来个为过还没开长门问间车东马鸟鱼语话请谢电机气书买卖见听写实现发应该"
TRADITIONAL_ONLY = "們這國學說時會對來個為過還沒開長門問間車東馬鳥魚語話請謝電機氣書買賣見聽寫實現發應該"
# Literal token that marks a line break in token tables.
NEWLINE_TOKEN = "[\\n]"

# --------------------------------------------------------------------------
# Portable patterns of our own (valid in Java regex and RE2 alike)
# --------------------------------------------------------------------------

# A word token or a single symbol; whitespace separates tokens.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f]"
# A sentence starts at a non-blank character, runs to the next terminator run
# or line break.
SENTENCE_PATTERN = r"[^ \t\n\r\f][^.!?\r\n]*[.!?]*"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
