"""Regular expressions shared by all text functions.

`\\w` and `\\s` mean different things in different engines, so the classes are written out.
"""

# fixed values
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"

HTML_TAG = r"<[^>]+>"
URL = r"https?://" + NON_SPACE + "+"
HANDLE = "@" + WORD + "+"
HASHTAG = "#" + WORD + "+"
SPACE_RUN = SPACE + "+"
# the same without runs of one plain space, which most are
SPACE_RUN_NOT_PLAIN = r"[\t-\r\x1c-\x1f\x85\p{Z}&&[^ ]]" + SPACE + "*| " + SPACE + "+"
SENTENCE_END = r"[.!?]+"
LM_TOKEN = WORD + "+"
TERM_TOKEN = WORD + "{2,}"
