"""Patterns that classify paragraphs.

Fixed values: they must be these for results to be right. White space in them is ASCII, as ``normalised`` text has it;
digits are those of any script (full-width ones are common in Chinese handouts).
"""

# Fixed values: (pattern, weight) of what makes a paragraph look like a question.
QUESTION = [
    (r"[A-D][.．、]\s*\S", 3),
    (r"[（(]\s*[）)]\s*$", 3),
    (r"__+", 2),
    (r"^[A-D]\s*[.．、]?\s*[①②③④]?", 3),
    (r"【多选】", 2),
    (r"[（(]\s*\p{Nd}{4}\s*[.·]\s*", 2),
    (r"[（(]\s*\p{Nd}{4}\s*年\s*", 1),
    (r"以下(说法|选项|正确|错误|正确的|错误的是)", 1),
    (r"(正确的是|错误的是|正确的是\s*[（(])", 1),
    (r"[（(]\s*填\s*[）)]", 1),
    (r"(如图所示|如图|下图|如图所示).{0,20}(正确的是|正确)", 1),
    (r"^\s*\p{Nd}{1,3}\s*[.．]\s*[（(]\s*\p{Nd}{4}", 3),
    (r"^\s*\p{Nd}{1,3}\s*[.．]\s*[（(]", 2),
    (r"^\s*\p{Nd}{1,3}\s*[.．、)）]\s*\S", 1),
]

# Fixed values: (pattern, weight) of what makes a paragraph look like knowledge.
KNOWLEDGE = [
    (r"^(知识点|考点|知识要点|知识梳理|核心知识|重难点)\s*\p{Nd}*", 3),
    (r"^[一二三四五六七八九十]+[、.．]\s*[^\p{Nd}]", 3),
    (r"\(\p{Nd}+\)\s*(定义|公式|概念|性质|定理|法则|方法)", 3),
    (r"(等于|表示|其中|单位是|叫做|称为|即为|定义为)", 1),
    (r"(公式|规律|原理|定律|概念|性质)", 1),
    (r"[=＝]\s*\S+\s*[/÷]", 2),
    (r"^(口诀|注意|说明|提醒|易错|技巧|方法)", 2),
    (r"【例\s*\p{Nd}+】", 3),
    (r"^例\s*\p{Nd}+\s*[.．]\s*", 3),
    (r"^例\s*\p{Nd}+\s*", 3),
    (r"^【典例】", 3),
    (r"^【典例精讲】", 3),
    (r"^【深化点拨】", 3),
    (r"^【角度\p{Nd}+】", 2),
    (r"^【题型\s*\p{Nd}+\s*", 2),
    (r"^【题型[一二三四五六七八九十]+】", 2),
    (r"^0[123]\s+[^\s]+·[^\s]+", 2),
    (r"^重难\p{Nd}+", 3),
    (r"^(课标单词|目标短语|常考句型|重点语法|知识清单)", 3),
    (r"^【解题技巧】", 2),
    (r"^【考法预测】", 2),
    (r"^【答案与解析】", 2),
    (r"^【语篇导读】", 2),
    (r"^【长难句分析】", 2),
    (r"^【答案】", 1),
    (r"^【详解】", 1),
    (r"^【分析】", 1),
    (r"^【解析】", 1),
    (r"^【解答】", 1),
    (r".{100,}", 1),
]

# Patterns at which practice begins.
BOUNDARY = [
    r"^【真题】",
    r"^【题目】",
    r"^【对点训练】",
    r"^【当堂检测】",
    r"^【课后作业】",
    r"^【巩固训练】",
    r"^【真题演练】",
    r"^【即学即练】",
    r"^【变式训练】",
    r"^【拓展训练】",
    r"^【真题再现】",
    r"^【强化训练】",
    r"^【综合训练】",
    r"^【模拟演练】",
    r"^【考前冲刺】",
    r"^【限时训练】",
    r"^【达标检测】",
    r"^【学以致用】",
    r"^第[一二三四五六七八九十\p{Nd}]+部分",
    r"^专题\s*\p{Nd}+\s*$",
    r"^专题\s*\p{Nd}+[：:\s].{1,12}$",
    r"^考点\s*\p{Nd}+",
    r"^(真题|进阶|拔高|能力|综合|素养|考向|命题)[·・]",
    r"^拔高[・·].{0,6}$",
    r"^(基础演练|能力进阶|综合提升|拓展延伸)$",
    r"^0[45]\s+[^\s]+·[^\s]+",
    r"^[一二三四五六七八九十]+[、.．]\s*(完成句子|完型填空|阅读理解|短文填空|语法填空|写作|听力)",
    r"(?i)^Passage\s+\p{Nd}+",
    r"(?i)^Passage\s+[A-F]$",
    r"(?i)^Reading\s+Comprehension",
    r"(?i)^Read\s+the\s+following\s+passage",
    r"(?i)^Exercise\s+\p{Nd}+",
    r"(?i)^Practice\s+\p{Nd}+",
    r"(?i)^Test\s+\p{Nd}+",
    r"(?i)^Quiz\s+\p{Nd}+",
    r"(?i)^Cloze\s+\p{Nd}+",
    r"(?i)^Writing\s+Task",
    r"^(以下(说法|正确|错误)|(下列|如下)说法)\s*[（(]",
    r"^(即时训练|巩固练习|课后作业|当堂检测|出门测试|课堂练习|随堂检测)$",
]

# Fixed values: (pattern, type) of section headings; the first that matches decides.
SECTION = [
    (r"^第[一二三四五六七八九十\p{Nd}]+部分", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+章", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+节", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+讲", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+课时", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+单元", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+模块", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+板块", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+环节", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+篇", "mixed"),
    (r"^第[一二三四五六七八九十\p{Nd}]+段", "mixed"),
    (r"^专题\s*\p{Nd}+", "mixed"),
    (r"^考点\s*\p{Nd}+", "knowledge"),
    (r"^题型\s*\p{Nd}+", "practice"),
    (r"^知识点\s*\p{Nd}+", "knowledge"),
    (r"^微专题\s*\p{Nd}+", "mixed"),
    (r"^[一二三四五六七八九十]+[、.．]\s*[^\p{Nd}]", "mixed"),
    (r"^[一二三四五六七八九十]+$", "mixed"),
    (r"^[（(][一二三四五六七八九十\p{Nd}]+[）)]", "mixed"),
    (r"^(考情|基础|方法|技巧|知识|考点)[·・]", "knowledge"),
    (r"^(拔高|真题|进阶|能力|综合|素养|命题|考向)[·・]", "practice"),
    (r"^(重难)[·・]", "mixed"),
    (r"^0[123]\s+[^\s]+·[^\s]+", "knowledge"),
    (r"^0[45]\s+[^\s]+·[^\s]+", "practice"),
    (r"^\p{Nd}{2}\s+[^\s]+·[^\s]+", "mixed"),
    (r"^(拔高|基础|能力|进阶|重难|考情|真题)[・·].{1,20}$", "mixed"),
    (r"^重难\s*\p{Nd}+", "knowledge"),
    (r"(?i)^Part\s+\p{Nd}+", "mixed"),
    (r"(?i)^Part\s+[A-F]$", "mixed"),
    (r"(?i)^Section\s+\p{Nd}+", "mixed"),
    (r"(?i)^Section\s+[A-F]$", "mixed"),
    (r"(?i)^Unit\s+\p{Nd}+", "mixed"),
    (r"(?i)^Module\s+\p{Nd}+", "mixed"),
    (r"(?i)^Lesson\s+\p{Nd}+", "mixed"),
    (r"(?i)^Chapter\s+\p{Nd}+", "mixed"),
    (r"(?i)^Topic\s+\p{Nd}+", "mixed"),
    (r"(?i)^Theme\s+\p{Nd}+", "mixed"),
    (r"(?i)^Stage\s+\p{Nd}+", "mixed"),
    (r"(?i)^Phase\s+\p{Nd}+", "mixed"),
    (r"(?i)^Level\s+\p{Nd}+", "mixed"),
    (r"(?i)^Round\s+\p{Nd}+", "mixed"),
    (r"(?i)^Step\s+\p{Nd}+", "mixed"),
    (r"(?i)^Task\s+\p{Nd}+", "mixed"),
    (r"(?i)^Activity\s+\p{Nd}+", "mixed"),
    (r"(?i)^Passage\s+\p{Nd}+", "practice"),
    (r"(?i)^Passage\s+[A-F]$", "practice"),
    (r"(?i)^Reading\s+\p{Nd}+", "practice"),
    (r"(?i)^Reading\s+Comprehension", "practice"),
    (r"(?i)^Read\s+the\s+following\s+passage", "practice"),
    (r"(?i)^Exercise\s+\p{Nd}+", "practice"),
    (r"(?i)^Practice\s+\p{Nd}+", "practice"),
    (r"(?i)^Test\s+\p{Nd}+", "practice"),
    (r"(?i)^Quiz\s+\p{Nd}+", "practice"),
    (r"(?i)^Cloze\s+\p{Nd}+", "practice"),
    (r"(?i)^Grammar\s+Focus", "knowledge"),
    (r"(?i)^Writing\s+Task", "practice"),
    (r"^[IVX]+[.．]\s+[^\p{Nd}]", "mixed"),
    (r"^目录$", "toc"),
    (r"(?i)^Contents$", "toc"),
    (r"\.{5,}", "toc"),
    (r"^[~/\\\-_=*#]{10,}\s*$", "separator"),
    (r"^[◆◇★☆●○◎□■△▲▽▼◉⊕⊗]{3,}\s*$", "separator"),
]

# Pairs of headings of basic and of advanced practice.
PRACTICE_PAIRS = [
    ("基础速刷", "能力跃升"),
    ("基础训练", "能力提升"),
    ("基础演练", "能力进阶"),
    ("基础练习", "综合提升"),
    ("基础巩固", "拔高训练"),
    ("对点训练", "拓展训练"),
    ("即学即练", "变式训练"),
    ("真题闯关", "课后三阶"),
    ("基础达标", "素养提升"),
    ("基础篇", "提高篇"),
    ("A组", "B组"),
    ("基础过关", "能力突破"),
]

# Single patterns.
TYPE_MARKER = r"^【?题型\s*(\p{Nd}+)"
NUMBER = r"^\s*(\p{Nd}{1,3})\s*[.．、)）]"
MAIN_NUMBER = r"^\s*(\p{Nd}{1,3})\s*[．、.]\s*\S"
DOTTED = r"\.{5,}"
KNOWLEDGE_HEADING = r"^[一二三四五六七八九十]+[、.．]|^(重难\p{Nd}+|【解题技巧】|【考法预测】|知识点|考点|知识要点|知识梳理|核心知识|Part\s+\p{Nd}+|Section\s+\p{Nd}+|Passage\s+\p{Nd}+|Unit\s+\p{Nd}+|Lesson\s+\p{Nd}+)"
OPTION = r"^\s*[A-D]\s*[.．、]"
BLANK = r"[（(]\s*[）)]\s*$|__+"
#: What answers begin with, and the headings at which what an answer takes with it ends.
ANSWER = r"【答案】|【详解】|【解析】|参考答案[：:．]|参考解析[：:．]|【解答】|[（(]\s*(?:答案|详解|解析)\s*[）)]"
ANSWER_ENDS = r"(?i)^\s*([一二三四五六七八九十]+[、.．]\s*\S|题型|考点|知识点|专题|Part|Section|Lesson|Unit)"
#: What questions begin with where answer space is left, and what tells that one has options or blanks of its own.
QUESTION_HEADER = r"^\s*(\p{Nd}{1,3}\s*[.．、]|[（(]\s*\p{Nd}+\s*[）)])"
CHOICE_LINE = r"(?i)^[A-D][.．、]"
BLANK_SPACE = r"___|（\s*）|\(\s*\)"
MARKER_KNOWLEDGE, MARKER_DRILL, MARKER_CONSOLIDATION = "知识精讲", "即时训练", "六、巩固练习"
CLASS_KNOWLEDGE, CLASS_CONSOLIDATION = "知识精讲&例题讲解", "六、出门测试"

# Words that mark where practice and where consolidation begins, in the order in which they are looked for.
PRACTICE_WORDS = [
    "基础速刷", "基础训练", "基础演练", "基础练习", "基础巩固", "基础达标", "对点训练", "即学即练", "真题闯关",
    "真题演练", "当堂检测", "随堂检测", "课堂练习", "达标检测", "基础篇", "A组", "即时训练",
]
STRONG_PRACTICE_WORDS = ["基础速刷", "基础训练", "真题闯关", "即时训练"]
CONSOLIDATION_WORDS = [
    "能力跃升", "能力提升", "能力进阶", "能力突破", "综合提升", "综合训练", "拔高训练", "拓展训练", "变式训练",
    "课后三阶", "素养提升", "提高篇", "B组", "巩固练习", "出门测试", "出门测速",
]
STRONG_CONSOLIDATION_WORDS = ["能力跃升", "能力提升", "课后三阶", "巩固练习"]

# Words in headings of a table of contents.
TOC_BASIC = [
    "基础训练", "基础巩固", "基础过关", "基础达标", "基础速刷", "基础演练", "基础练习", "基础篇", "对点训练", "即学即练",
    "当堂检测", "随堂检测", "课堂练习", "达标检测", "真题闯关", "溯源演练", "真题演练", "真题再现", "真题", "即时训练",
]
TOC_ADVANCED = [
    "培优训练", "培优提升", "培优", "提优训练", "提优", "能力提升", "能力跃升", "能力进阶", "能力突破", "综合提升",
    "综合训练", "综合应用", "拔高训练", "拔高", "拓展训练", "拓展提升", "拓展延伸", "变式训练", "课后三阶", "精准练习",
    "分层集训", "巩固练习", "巩固训练", "出门测试", "素养提升", "提高篇", "B组",
]
TOC_PRACTICE = ["完成句子", "完型填空", "阅读理解", "短文填空", "语法填空", "写作", "听力", "模拟", "强化演练"]
TOC_KNOWLEDGE = [
    "考情", "分析解读", "备考策略", "命题预测", "基础", "知识梳理", "知识导图", "核心梳理", "重难", "核心突破", "教材精研",
    "内容全解", "本节导航", "目标清单", "避坑指南", "解题通法", "课标单词", "目标短语", "常考句型", "重点语法", "知识清单",
    "课堂启动", "知识回顾", "归纳总结", "解题技巧", "考法预测", "答案与解析", "语篇导读", "长难句分析", "深化点拨",
    "典例精讲", "典型例题", "经典例题", "例题讲解",
]

# Single patterns of the tiers, of candidates and of example groups.
SEPARATOR = r"^[~/\-_=*#]{10,}\s*$"
#: What every separator begins with, whatever slashes it ends with.
DECOR_BEGINS = r"^[~/\-_=*#]{10}"
SECTION_HEADER = r"(?i)^([一二三四五六七八九十]+[、.．]|(题型|考点|知识点|专题|Part|Section|Lesson|Unit))"
PART_HEADER = r"^(即时训练|巩固练习|归纳总结|课堂启动|知识回顾|出门测试)"
ENGLISH = r"^[A-Za-z0-9\s,.!?;:\"'\-()]{30,}"
READING = r"^【真题再现】"
READING_ENDS = r"^(重难\p{Nd}+|【解题技巧】|【考法预测】|【答案与解析】|【语篇导读】|【长难句分析】|知识点|考点|知识要点|知识梳理|核心知识|[一二三四五六七八九十]+[、.．]\s*[^\p{Nd}])"
READING_START = r"(?i)^(【真题再现】|Passage\s+\p{Nd}+|Reading\s+Comprehension)"
COURSE_SECTION = r"^(0[1-5])\s+(.+)$"
YEAR_TAG = r"[（(]\s*\p{Nd}{4}\s*[.·年]"
DECOR = r"^[/\\~\-_=*#\s·.。、，,|]*$"
TYPE_ROW = r"^【题型\s*\p{Nd}+"
EXAM_QUESTION = r"^\s*\p{Nd}{1,3}\s*[.．、]\s*[（(]\s*(20\p{Nd}\p{Nd}|\p{Nd}{2}-)"
SECTOR = r"提升专练|真题感知"
TOC_SECTION = r"^0(\p{Nd})\s+[^\s]+·[^\s]+"
TOC_NUMBERED = r"^(第[一二三四五六七八九十\p{Nd}]+[部分章节课时单元模块]|专题\s*\p{Nd}+|考点\s*\p{Nd}+)"
_SECTION_NAMED = r"\s+[^\s]+·[^\s]+"
#: (pattern, role) of headings, by words first and then by numbers; the first that matches decides.
TOC_ROLES = [
    ("|".join(TOC_ADVANCED), "advanced_practice"), ("|".join(TOC_BASIC), "basic_practice"), ("|".join(TOC_PRACTICE), "practice"), ("|".join(TOC_KNOWLEDGE), "knowledge"),
    ("^0[0-3０-３]" + _SECTION_NAMED, "knowledge"), ("^0[4４]" + _SECTION_NAMED, "basic_practice"), ("^0[5-9５-９]" + _SECTION_NAMED, "advanced_practice"), (TOC_NUMBERED, "practice"),
]

# Patterns of the rules that tell paragraphs apart one by one.
EXAMPLE = r"^【例\s*\p{Nd}+】|^例\s*\p{Nd}+\s*[.．]|^【典例】|^【典例精讲】"
SUMMARY = r"^(归纳总结|课堂启动|知识回顾|知识小结)"
ANSWER_HEADER = r"^【答案与解析】|^【答案】|^【详解】|^【解析】|^【解答】"
PRACTICE_HEADER = r"^(即时训练|巩固练习|课后作业|当堂检测|出门测速|课堂练习|随堂检测|达标检测|真题演练|即学即练|变式训练|拓展训练|强化训练|综合训练|模拟演练|考前冲刺|限时训练|学以致用)"
KNOWLEDGE_HEADER = r"^(知识点|考点|知识要点|知识梳理|核心知识|重难点)\s*\p{Nd}*|^[一二三四五六七八九十]+[、.．]\s*[^\p{Nd}]"
CONCEPT = r"(定义|公式|性质|定理|法则|概念|原理|规律|方法)"
STRUCTURE_HEADER = r"(?i)^[一二三四五六七八九十]+[、.．]|^(题型|考点|知识点|专题|Part|Section|Lesson|Unit|Read|Passage|Exercise|Practice|Test|Quiz|Cloze|Writing|Grammar)"
NUMBERED_QUESTION = NUMBER + r"\s*\S"
FILL_IN = r"（填.*）"
EXAM_YEAR = r"[（(]\s*\p{Nd}{4}\s*[.·]\s*"

# Titles of tables of contents, headings that stand in for one, and what is taken off a heading.
TOC_TITLES = ["目录", "Contents", "CONTENTS", "目  录"]
NAV_HEADER = r"^(考情|基础|重难|拔高|真题|进阶|能力|综合|素养|方法|技巧|知识|考点|命题|考向)[·・]|^(基础训练|基础巩固|基础过关|基础达标|基础速刷|基础演练|基础练习|对点训练|即学即练|即时训练)$|^(培优训练|培优提升|提优训练|能力提升|能力跃升|能力进阶|能力突破|综合提升|拔高训练|拓展训练|课后三阶|巩固练习)$"
NAV_DECOR = r"^[^\x{4e00}-\x{9fff}A-Za-z0-9]+"
NAV_BRACKETS = r"^[【】\[\]（）()：: ]+|[【】\[\]（）()：: ]+$"
NAV_ORDINAL = r"^[一二三四五六七八九十]+[、.．]\s*"
PARENTHESES = r"[（(][^）)]*[）)]"
NO_WORD = r"[^\p{L}\p{N}_]"

# Words in names of versions, and what is said of files that are refused.
TEACHER_WORDS = ["教师", "解析", "答案", "教师版", "解析版"]
STUDENT_WORDS = ["学生", "学生版", "空白", "原卷", "原卷版"]
BAD_KIND, SAME_NAME = "仅支持 ZIP 和 DOCX，请移除无效文件", "存在同名文件，请先重命名，避免素材覆盖"

# Words that say nothing about a topic, in the order of use, version, textbook, school year and subject.
TOPIC_NOISE = [
    "专题讲义", "讲义", "专题", "训练题", "练习题", "测试题", "试题", "试卷", "习题", "练习", "训练", "测试", "导学案", "学案", "教案",
    "复习讲义", "同步练习", "专题训练", "单元测试", "单元复习", "期中复习", "期末复习", "一轮复习", "二轮复习", "总复习", "综合复习",
    "期中", "期末", "复习", "综合训练", "专题复习", "模块复习",
    "解析版", "答案版", "教师版", "学生版", "空白版", "原卷版", "解析", "答案", "教师用", "学生用", "教师", "学生", "空白", "原卷",
    "人教版", "人教A版", "人教B版", "人教2024版", "人教新目标", "北师大版", "苏教版", "沪教版", "鲁教版", "湘教版", "粤教版",
    "华师大版", "浙教版", "冀教版", "青岛版", "北京版", "教科版", "外研版", "译林版", "牛津版", "仁爱版", "科普版",
    "高一", "高二", "高三", "初中", "高中", "小学", "七年级", "八年级", "九年级", "必修", "选修", "选择性必修", "上册", "下册", "全册",
    "学年", "学期", "上学期", "下学期", "数学", "语文", "英语", "物理", "化学", "生物", "政治", "历史", "地理",
]

# Patterns that are taken out of a name for its topic: of the whole name, of its parts, and of what is left, one after the other.
TOPIC_WHOLE = r"[【\[][^】\]]*[】\]]|[（(][^）)]*[）)]|^\s*\p{Nd}{1,3}\s*[.．、)）]|^\s*第\s*\p{Nd}+\s+|^\s*第[一二三四五六七八九十百零\p{Nd}]+[章节讲]|\p{Nd}{4}\s*[-－—~]\s*\p{Nd}{4}|\p{Nd}{4}\s*学年"
TOPIC_SPLIT = r"[\s·\-－—_/,，、;；:：]+"
TOPIC_PART = r"第[一二三四五六七八九十百零\p{Nd}]+[章节讲段课单元模块部分]|第\s*\p{Nd}+\s+|第\s*\p{Nd}+\s*[章节讲段课单元模块部分]|\b\p{Nd}+\s*[章节讲段课单元模块部分]"
TOPIC_LEFT = [
    r"^\s*\p{Nd}+\s*[.．、)）:：]?\s*",
    r"^第\s*\p{Nd}+(\.\p{Nd}+)?\s*[章节讲段课单元模块部分]?\s*",
    r"^\p{Nd}{1,3}\s+",
    r"^(考点|知识点|专题|题型|第[一二三]\s*讲)\s*\p{Nd}*\s*",
    r"[（(]\p{Nd}{4}\s*[-－—~]\s*\p{Nd}{4}[）)]",
    r"\p{Nd}{4}\s*[-－—~]\s*\p{Nd}{4}",
    r"[（(]\p{Nd}{4}[）)]",
    r"[^\x{4e00}-\x{9fff}\p{L}\p{N}_\s]",
]
TOPIC_EDGE_PART = r"^[（）()【】\[\] \-_·]+|[（）()【】\[\] \-_·]+$"
TOPIC_EDGE = r"^[（）()【】\[\] \-_·，,。.：:！!？?、]+|[（）()【】\[\] \-_·，,。.：:！!？?、]+$"
EXTENSION = r"([^.])\.[^.]*$"

# What objectives are drawn from, and their wording.
OBJECTIVE_KNOWLEDGE = r"^(知识点|考点|知识要点|知识梳理|要点|概念|定义|公式|定理|性质|法则|方法|规律|技巧|注意|说明|提醒|小结)[\s：:、]*\p{Nd}*"
OBJECTIVE_ORDERED = r"^[一二三四五六七八九十]+[、.． ](.+)$"
OBJECTIVE_TYPE = r"^【?\s*题型\s*\p{Nd}+\s*】?\s*"
OBJECTIVE_EXAMPLE = r"^例\s*\p{Nd}+"
OBJECTIVE_EXCLUDED = ["题型", "练习", "训练", "巩固", "测试"]
OBJECTIVE_TAGS = ["基础速刷", "能力跃升", "能力提升", "提优训练", "拔高训练", "真题闯关", "课后三阶", "对点训练", "即学即练", "变式训练", "拓展训练", "强化训练", "综合训练", "模拟演练"]
OBJECTIVE_TEXTS = {
    "knowledge": "①掌握{topic}核心知识：{names}等；", "no_knowledge": "①掌握{topic}的核心概念与基本方法；", "counted": "②掌握{part}题型的解法，共{count}道题；", "uncounted": "②掌握{part}题型的解法，熟练求解；", "skills": "③培养运算与推理能力，形成知识体系。",
    "any_part": "本专题典型问题", "key": "重点：{topic}核心概念（{names}）的理解与应用；", "no_key": "重点：{topic}核心知识点与基本方法；", "hard": "难点：{part}的综合运用与易错点辨析。", "no_hard": "难点：知识的综合运用与易错点辨析。",
}

# What checks of blocks and uploads say, and lines of reports.
NO_ROWS, BLOCK_COUNT, BLOCK_OUTSIDE, BLOCK_RANGE, BLOCK_OVER = "文档无段落", "blocks 数量不是 3：", " 越界：", " 不在 ", " 与上一块重叠：start="
NO_FILES, BAD_OPTIONS, NO_INPUT = "未收到文件", "不支持的生成配置", "未发现 zip 或 docx 文件"
GROUP_LINE = "例题组: "
UPLOAD_OPTIONS = {"template_type": ["1v1", "class"], "split_mode": ["smart", "candidate", "ideal", "full"], "docx_mode": ["auto", "separate"]}
