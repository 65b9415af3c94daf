"""Term groups of the span router, English and Chinese."""

# The router's lexicon.
ROLE = ("wife", "husband", "teacher", "boss", "manager", "client", "friend", "colleague", "student", "mentor", "partner")
ROLE_ZH = ("妻子", "丈夫", "老师", "上司", "领导", "同事", "朋友", "客户", "学生", "导师", "伙伴")
PRONOUN = ("i", "you", "he", "she", "they", "this", "that", "my", "his", "her", "their")
PRONOUN_ZH = ("我", "你", "他", "她", "他们", "她们", "这个", "那个", "对方", "我的", "他的", "她的")
FIRST_PERSON = ("i", "me", "my", "mine", "we", "us", "our", "ours")
FIRST_PERSON_ZH = ("我", "我的", "我们", "我们的")
OTHER_PERSON = ("you", "your", "yours", "he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs")
OTHER_PERSON_ZH = ("你", "你的", "你们", "你们的", "他", "他的", "她", "她的", "他们", "她们", "对方")
LOGICAL = ("because", "therefore", "but", "although", "if", "unless", "however", "otherwise", "instead")
LOGICAL_ZH = ("因为", "所以", "但是", "虽然", "如果", "否则", "不过", "于是", "算了", "还是")
IMPORTANCE = ("important", "must", "cannot fail", "personally", "urgent", "worried", "treasured", "high stakes", "cannot be wrong")
IMPORTANCE_ZH = ("重要", "必须", "不能有闪失", "亲自", "赶紧", "担心", "珍藏", "不能错", "非常重视")
EVENT = ("said", "asked", "decided", "planned", "worried", "hoped", "required", "prepared", "changed", "refused", "wrote", "wants", "needs")
EVENT_ZH = ("说", "要求", "决定", "准备", "认为", "担心", "希望", "计划", "拒绝", "写")

GROUPS = {
    "role": (ROLE, ROLE_ZH),
    "pronoun": (PRONOUN, PRONOUN_ZH),
    "first_person": (FIRST_PERSON, FIRST_PERSON_ZH),
    "other_person": (OTHER_PERSON, OTHER_PERSON_ZH),
    "logical": (LOGICAL, LOGICAL_ZH),
    "importance": (IMPORTANCE, IMPORTANCE_ZH),
    "event": (EVENT, EVENT_ZH),
}
