"""Patterns of the text rules, written so that Java, RE2 and Python read them alike."""

# Line shapes that mark headings, bullets and date ranges.
DATE_RANGE = r"(?i)[0-9]{4}[./-][0-9]{1,2}[ \t]*[-~–—][ \t]*([0-9]{4}[./-][0-9]{1,2}|至今|present)"
NUMBERED_HEADING = r"^([0-9]+(\.[0-9]+)*|[IVXivx]+)[、. \t]+[^ \t]+"
CHAPTER_HEADING = r"^第[一-龥0-9]+[章节篇部]"
BULLET = r"^[ \t]*([-*+]|[0-9]+[.)]|[•●◦])[ \t]+"
HEADING_WORDS_ZH = "背景|技能|经历|简介|摘要|目录|材料|步骤|做法|注意|章节|项目|自我|评价|教育|条款|定义|结论"
# The English counterpart of the word list (ours).
HEADING_WORDS_EN = (
    r"\b(background|skills|experience|profile|abstract|contents|materials|steps|method|notes|"
    r"chapter|project|education|terms|definitions?|conclusions?)\b"
)
HEADING_WORD = rf"(?i)({HEADING_WORDS_ZH}|{HEADING_WORDS_EN})"

# Line shapes counted by the document profile.
PROFILE_NUMBERED = r"^[0-9]+(\.[0-9]+)*[、. \t]+"
CODE_LINE_END = r"[{};][ \t]*$"
CODE_LINE_START = r"^(```|def |class |function |import |from )"
DATE_LIKE = r"[0-9]{4}[-/.][0-9]{1,2}([-/.][0-9]{1,2})?"
CODE_FENCE = r"```[\s\S]*?```"
