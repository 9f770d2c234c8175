"""Word lists of the name layers. FIXED VALUES: results depend on them, so they stand here plainly and as they are."""

# Single-character surnames of the heuristic layer.
SURNAMES = (
    "王", "李", "张", "刘", "陈", "杨", "黄", "赵", "周", "吴", "徐", "孙", "马", "胡", "朱", "郭", "何", "罗", "高", "林",
    "郑", "梁", "谢", "宋", "唐", "许", "韩", "冯", "邓", "曹", "彭", "曾", "肖", "田", "董", "袁", "潘", "于", "蒋", "蔡",
    "余", "杜", "叶", "程", "苏", "魏", "吕", "丁", "任", "沈", "姚", "卢", "姜", "崔", "钟", "谭", "陆", "汪", "范", "金",
    "石", "廖", "贾", "夏", "韦", "付", "方", "白", "邹", "孟", "熊", "秦", "邱", "江", "尹", "薛", "闫", "段", "雷", "侯",
    "龙", "史", "陶", "黎", "贺", "顾", "毛", "郝", "龚", "邵", "万", "钱", "严", "覃", "武", "戴", "莫", "孔", "向", "汤",
    "温", "康", "施", "文", "牛", "樊", "葛", "常", "邢", "安", "裴", "倪", "庄", "聂", "章", "鲁", "岳", "齐", "伍", "霍",
    "翟", "柳", "焦", "卞", "查", "管", "柏", "祝", "蓝", "单", "解", "童", "应", "路", "穆", "靳", "涂", "詹", "殷", "纪",
    "舒", "祁", "柯", "米", "梅", "尚", "边", "盛", "甄", "耿", "宁", "苗", "凌", "栗", "贝", "庞", "项", "颜", "欧", "阮",
    "辛", "兰", "符", "游", "连", "关", "荣", "虞", "乔", "滕", "褚", "喻", "郁", "容", "牟", "鲍", "卜", "臧", "仇", "练",
    "晏", "储", "席", "卓", "成", "池", "仲", "鞠", "芮", "禹", "班", "邬", "寇", "简", "阳", "巫", "束", "扈", "蒯", "甘",
    "房", "缪", "沙", "车", "巩", "隋", "楚", "伊", "刁", "翁", "菅", "娄", "麦", "荆", "郜", "来", "党", "植", "原", "惠",
    "暴", "冀", "隆", "封", "都", "邝", "茹", "养", "燕", "艾", "鄢", "宗", "包", "全", "申", "俞", "佟", "言", "花",
)

# Two-character surnames of the heuristic layer.
COMPOUND = (
    "欧阳", "司马", "诸葛", "上官", "东方", "皇甫", "令狐", "慕容", "夏侯", "公孙", "宇文", "尉迟",
    "长孙", "轩辕", "南宫", "端木", "独孤", "百里", "呼延", "太史", "公冶", "司徒", "东郭", "羊舌",
)

# Words near names.
TRIGGERS = (
    "老师", "同学", "家长", "联系人", "收件人", "抄送", "致电", "微信", "姓名", "学生", "负责人", "经理", "主任", "先生", "女士", "医生",
    "护士", "教授", "博士", "院长", "处长", "局长", "书记", "员工", "职员", "专员", "顾问", "总监", "董事", "会计", "律师",
)

# Words that no name holds.
ORG_PARTS = (
    "公司", "集团", "有限", "股份", "企业", "工厂", "研究院", "研究所", "科技", "技术", "网络", "电子", "电气", "机械", "材料", "化工",
    "医药", "医疗", "生物", "制药", "食品", "服装", "纺织", "建筑", "工程", "设计", "咨询", "投资", "贸易", "物流", "运输", "通信",
    "信息", "软件", "系统", "智能", "环保", "能源", "新能源", "汽车", "设备", "仪器", "仪表", "检测", "制造", "加工", "印刷", "包装",
)

# Words whose neighbourhood is an organisation's, and places in front of its name.
ORG_NEAR = ("企业", "公司", "集团", "有限", "股份", "责任", "技术中心", "研发中心", "总部", "分公司", "子公司", "办事处", "工作室")
ORG_BEFORE = (
    "杭州", "浙江", "上海", "北京", "深圳", "广州", "南京", "苏州", "宁波", "温州", "嘉兴", "绍兴", "金华",
    "台州", "湖州", "衢州", "丽水", "舟山", "中国", "国际", "亚洲", "东方", "西方", "南方", "北方",
)

# Last characters of organisations and places, and characters of titles.
ORG_ENDS = ("公", "司", "限", "份", "厂", "院", "所", "区", "市", "省", "县", "镇", "村")
TITLE_CHARS = ("老", "师", "教", "授", "博", "士", "生", "员", "长", "官", "主", "任")

# Terms of which no beginning is a name.
TERMS = ("物联网", "高效性", "金融科", "方法论", "程序员", "计算机", "普适计", "区块链")

# Common words that are no names, as far as the lists above don't tell.
NOT_NAMES = (
    "郑重", "郑州", "任务", "任何", "任意", "任职", "任命", "任用", "任期", "任免", "范围", "范畴", "范本", "范例", "范式",
    "高层", "高端", "高度", "高级", "高性", "高技", "高新", "高质", "高速", "金属", "金额", "金价", "金钱", "金牌",
    "方案", "方向", "方面", "方式", "方程", "方便", "方针", "马上", "马力", "马达", "马路", "于是", "于此",
    "余额", "余数", "余下", "余地", "常见", "常用", "常规", "常量", "常态", "常务", "程度", "程式", "史料", "史记",
    "石油", "石化", "石材", "田野", "田地", "田间", "江河", "江南", "江苏", "江西", "江浙", "黄金", "黄色", "黄河",
    "周围", "周期", "周年", "周边", "周末", "周全", "周到", "吴越", "何时", "何地", "何处", "何况", "何必", "何以",
    "唐代", "唐朝", "唐山", "宋代", "宋朝", "陈述", "陈列", "陈旧", "陈设", "杨树", "孙子", "李子", "王朝", "王国", "王牌",
    "张扬", "张贴", "张力", "张开",
    "中国", "北京", "上海", "广州", "深圳", "杭州", "南京", "苏州", "武汉", "上城", "下城", "拱墅", "西湖", "滨江", "余杭",
    "萧山", "临安", "富阳", "桐庐", "淳安", "建德", "钱塘", "临平", "浙江",
    "互联", "研究", "评价", "评估", "评审", "评定", "认定", "认证", "资料", "证明", "报告", "申请", "审批", "批准", "承诺",
    "规范", "规定", "规则", "规划", "法规", "法律", "法定", "管理", "管辖", "管控",
    "提高", "提升", "提供", "提出", "提交", "提请", "提案", "普通", "普遍", "普及", "验证", "验收", "验算", "承担", "承接", "承办",
    "物理", "物品", "物资", "物业", "手机", "电话", "地址", "邮箱", "微信", "新能", "图形", "图像", "图书", "图谱", "计划", "计量",
    "分析", "分布", "分类", "分割", "算法", "学习", "训练", "模型", "数据", "安全", "可靠", "稳定", "今天", "明天", "昨天", "年度",
    "这里", "那里", "什么", "怎么", "可以", "不能", "应该", "需要", "已经", "正在", "继续", "开始", "包括", "以及", "等等",
    "以下", "以上", "以内", "以外",
    "方法论", "申请人", "高新技", "高质量", "高效率", "金融业", "金融科", "金融服", "范围内", "范围为", "周期性", "周围的", "任务书", "任期内", "任务量",
    "郑重承诺", "郑重声明", "郑重其事", "范围之内", "范围以内",
)

# Surnames of the layer over segmented words.
WORD_SURNAMES = (
    "王", "李", "张", "刘", "陈", "杨", "黄", "赵", "周", "吴", "徐", "孙", "马", "胡", "朱", "郭", "何", "罗", "高", "林",
    "郑", "梁", "谢", "宋", "唐", "许", "韩", "冯", "邓", "曹", "彭", "曾", "肖", "田", "董", "袁", "潘", "于", "蒋", "蔡",
    "余", "杜", "叶", "程", "苏", "魏", "吕", "丁", "任", "沈", "姚", "卢", "姜", "崔", "钟", "谭", "陆", "汪", "范", "金",
    "石", "廖", "贾", "夏", "韦", "付", "方", "白", "邹", "孟", "熊", "秦", "邱", "江", "尹", "薛", "闫", "段", "雷", "侯",
    "龙", "史", "陶", "黎", "贺", "顾", "毛", "郝", "龚", "邵", "万", "钱", "严", "覃", "武", "戴", "莫", "孔", "向", "汤",
    "温", "康", "施", "文", "牛", "樊", "葛", "常", "邢", "安", "裴", "倪", "庄", "聂", "章", "鲁", "岳", "齐", "伍", "霍",
    "翟", "柳", "焦", "卞", "查", "管", "柏", "祝", "蓝", "单", "鲍", "卜", "巫",
    "傅", "介", "慕", "成", "欧", "司", "诸", "上", "东", "皇", "令", "淳", "瞿", "滕", "濮", "禹", "臧", "宓", "褚", "祁",
    "宁", "仇", "栾", "隋", "靳", "甄", "艾", "苗", "盛", "童", "费", "连", "应", "项", "阮", "和", "卓", "劳", "喜", "佟",
    "关", "游", "解", "原", "辛", "庞", "农", "边", "储", "屠",
)
WORD_COMPOUND = (
    "欧阳", "司马", "诸葛", "上官", "东方", "皇甫", "令狐", "慕容", "公孙", "轩辕", "西门", "夏侯",
    "南宫", "独孤", "长孙", "宇文", "尉迟", "淳于", "端木", "司徒", "司空", "钟离", "鲜于",
)

# Titles behind names, words near them, and ends of administrative units.
WORD_TITLES = ("老师", "教授", "博士", "先生", "女士", "同学", "医生", "院士", "主任", "经理", "总监")
WORD_NEAR = ("姓名", "联系人", "负责人", "老师", "同学", "先生", "女士")
DIVISIONS = ("省", "市", "县", "区", "镇", "乡", "村", "街道")

# Words that begin with a surname of that layer and are no names.
NOT_WORDS = (
    "郑重", "范围", "高效", "金融", "方法", "任务", "任何", "周围", "周期", "高级", "高度", "高技", "高新", "高速", "高层", "高端", "高质",
    "金属", "金额", "金钱", "金牌", "方案", "方向", "方面", "方式", "方便", "方程", "方针", "任意", "任职", "任命", "任免", "任期",
    "马上", "马力", "马达", "马路", "范畴", "范本", "范例", "范式", "余额", "余数", "余下", "余地", "常见", "常用", "常规", "常量", "常态", "常务",
    "程序", "程度", "程式", "史料", "史记", "石油", "石化", "石材", "田野", "田地", "田间", "江河", "江南", "江苏", "江西", "江浙",
    "黄金", "黄色", "黄河", "何时", "何地", "何处", "何况", "何必", "何以", "唐代", "唐朝", "唐山", "宋代", "宋朝",
    "陈述", "陈列", "陈旧", "陈设", "王朝", "王国", "王牌", "张扬", "张贴", "张力", "张开", "于是", "于此",
    "高效性", "高效率", "高质量", "高科技", "高新技", "高级教", "高级别", "高级的", "高中数", "高中语", "高中英", "高中物", "高中化", "高中生",
    "金融业", "金融科", "金融服", "范围内", "范围为", "任务书", "任务量", "任期内", "周期性", "周围的", "方法论", "方法学", "程序员",
    "高级教师", "高级职称", "高级工程", "高级技师", "高级会计", "高中数学", "高中语文", "高中英语", "高中物理", "高中化学", "高中生物",
    "单位", "文字学", "文字", "应用语",
)

# Surnames of the pattern recogniser.
PATTERN_SURNAMES = (
    "王", "李", "张", "刘", "陈", "杨", "黄", "赵", "周", "吴", "徐", "孙", "马", "胡", "朱", "郭", "何", "罗", "高", "林",
    "郑", "梁", "谢", "唐", "许", "冯", "曹", "彭", "曾", "肖", "田", "董", "袁", "潘", "于", "蒋", "蔡", "余", "杜", "叶",
    "程", "苏", "魏", "吕", "丁", "任", "沈", "姚", "卢", "姜", "崔", "钟", "谭", "陆", "范", "汪", "廖", "石", "金", "韦",
    "贾", "夏", "傅", "方", "邹", "熊", "孟", "秦", "白", "江", "阎", "薛", "尹", "段", "雷", "侯", "龙", "史", "陶", "黎",
    "贺", "毛", "郝", "顾", "龚", "邵", "邱", "钱", "戴", "严",
)
PATTERN_CONTEXT = ("姓名", "名字", "联系人", "先生", "女士", "同学", "老师")
