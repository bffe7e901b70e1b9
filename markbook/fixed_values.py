"""Values that results depend on, stated as they are.

Nothing here is logic: answer markers, prompt wording, role tokens and the
subject tables of the three supported exams.  Every value below is a FIXED VALUE;
changing one changes scores.
"""

# --- fixed values: answer-marker patterns, in priority order -----------------
# Written in Python ``re`` syntax for the letters A-D; functions/extract.py turns
# them into the JVM dialect and into other letter sets.

CASCADE = [
    r"correct answer is:\n\n\n([A-D]).",
    r"correct answer is:\n\n([A-D]).",
    r"correct answer is:\n([A-D]).",
    r"正確的答案應該是:.*?\b([A-D])\b",
    r"正确的答案应该是:.*?\b([A-D])\b",
    r"正確的選項應為:.*?\b([A-D])\b",
    r"正确的选项应为:.*?\b([A-D])\b",
    r"正確的答案是（([A-D])）",
    r"正确的答案是（([A-D])）",
    r"答案應該是:\s?選?項?\s?([A-D])",
    r"答案应该是:\s?选?项?\s?([A-D])",
    r"答案是:\s?選?項?\s?([A-D])",
    r"答案是:\s?选?项?\s?([A-D])",
    r"答案應為:\s?選?項?\s?([A-D])",
    r"答案应为:\s?选?项?\s?([A-D])",
    r"答案为:\s?选?项?\s?([A-D])",
    r"答案为：\s?选?项?\s?([A-D])",
    r"答案應為：\s?選?項?\s?([A-D])",
    r"答案应为：\s?选?项?\s?([A-D])",
    r"答案是：\s?选?项?\s?([A-D])",
    r"答案为\s?选?项?\s?([A-D])",
    r"答案选\s?选?项?\s?([A-D])",
    r"答案是\s?选?项?\s?([A-D])",
    r"所以下列方程式的解是([A-D])",
    r"答案应为\s?选?项?\s?([A-D])",
    r"正确的一项是\s?([A-D])",
    r"答案:\s?选?项?\s?([A-D])",
    r"答案应该是：\s?选?项?\s?([A-D])",
    r"答案：\s?选?项?\s?([A-D])",
    r"答案為:\s?([A-D])",
    r"答案应为：\s?([A-D])",
    r"答案為：\s?([A-D])",
    r"答案應該是:\s?([A-D])",
    r"正確答案為 \*\*([A-D])",
    r"正確答案為\(([A-D])\)",
    r"答案應為:\s?([A-D])",
    r"答案应为:\s?([A-D])",
    r"答案是 \*\*([A-D])",
    r"答案為 \*\*([A-D])",
    r"答案 ([A-D]) 正確",
    r"選項 ([A-D]) 正確",
    r"所以答案為([A-D])",
    r"答案：\(([A-D])\)",
    r"答案:\s?([A-D])",
    r"答案：\s?([A-D])",
    r"答案: ([A-D]) ",
    r"答案([A-D]) ",
    r"^選項([A-D])",
    r"^选项([A-D])",
    r"^選([A-D])",
    r"^选([A-D])",
    r"([A-D]). ",
    r"([A-D]).",
]

# The same markers with the loosest patterns tried first.
LOOSE_FIRST = [
    r"([A-D]). ",
    r"([A-D]).",
    r"^選([A-D])",
    r"^選項([A-D])",
    r"^选([A-D])",
    r"^选项([A-D])",
    r"答案是\s?選?項?\s?([A-D])",
    r"答案為\s?選?項?\s?([A-D])",
    r"答案應為\s?選?項?\s?([A-D])",
    r"答案为\s?选?项?\s?([A-D])",
    r"答案应为\s?选?项?\s?([A-D])",
    r"答案選\s?選?項?\s?([A-D])",
    r"答案选\s?选?项?\s?([A-D])",
    r"答案是:\s?選?項?\s?([A-D])",
    r"答案應該是:\s?選?項?\s?([A-D])",
    r"答案应该是:\s?选?项?\s?([A-D])",
    r"正確的一項是\s?([A-D])",
    r"正确的一项是\s?([A-D])",
    r"答案為:\s?選?項?\s?([A-D])",
    r"答案應為:\s?選?項?\s?([A-D])",
    r"答案:\s?選?項?\s?([A-D])",
    r"答案是：\s?選?項?\s?([A-D])",
    r"答案應該是：\s?選?項?\s?([A-D])",
    r"答案為：\s?選?項?\s?([A-D])",
    r"答案應為：\s?選?項?\s?([A-D])",
    r"答案：\s?選?項?\s?([A-D])",
    r"答案为:\s?选?项?\s?([A-D])",
    r"答案应为:\s?选?项?\s?([A-D])",
    r"答案:\s?选?项?\s?([A-D])",
    r"答案是：\s?选?项?\s?([A-D])",
    r"答案应该是：\s?选?项?\s?([A-D])",
    r"答案为：\s?选?项?\s?([A-D])",
    r"答案应为：\s?选?项?\s?([A-D])",
    r"答案：\s?选?项?\s?([A-D])",
]

# Markers of a worked (chain-of-thought) answer: traditional and simplified script.
COT_TRADITIONAL = [
    r"答案為(.+?)",
    r"選項(.+?)是正確的",
    r"因此，選項(.+?)",
    r"答案是(.+?)",
]
COT_SIMPLIFIED = [
    r"答案为(.+?)",
    r"选项(.+?)是正确的",
    r"因此，选项(.+?)",
    r"答案是(.+?)",
]

# --- fixed values: text folding ----------------------------------------------

# ASCII punctuation removed before two answers are compared.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Brackets that some servers reject, and the ASCII character each becomes.
BRACKETS = {
    "⟦": "[", "⟧": "]",
    "【": "[", "】": "]",
    "〖": "[", "〗": "]",
    "⦃": "{", "⦄": "}",
    "❨": "(", "❩": ")",
    "⟮": "(", "⟯": ")",
    "（": "(", "）": ")",
}

# Traditional to simplified, for the characters of the prompts and patterns here.
# Texts need a fuller table, which the caller passes in.
SCRIPT_CHARS = {
    "為": "为", "專": "专", "業": "业", "應": "应", "該": "该", "確": "确",
    "選": "选", "項": "项", "題": "题", "問": "问", "關": "关", "於": "于",
    "單": "单", "請": "请", "並": "并", "個": "个", "們": "们", "來": "来",
    "這": "这", "會": "会", "結": "结", "識": "识", "讓": "让", "試": "试",
    "對": "对", "錯": "错", "無": "无", "與": "与", "斷": "断", "麼": "么",
    "說": "说", "學": "学", "開": "开", "後": "后", "時": "时", "國": "国",
    "語": "语", "歷": "历", "體": "体", "實": "实", "發": "发", "現": "现",
}

# --- fixed values: prompt wording --------------------------------------------

ANSWER_CUE = "答案："
QUESTION_CUE = "問題："
SEGMENT_CUE = "問題: "
STEPS_CUE = "讓我們一步一步思考，\n"
WORKED_END = "所以答案是{answer}。"
SYSTEM_HEADER = "你是一位專業的中文AI助理，以下是關於{subject}考試單選題，請選出正確的答案。"
USER_HEADER = "以下是關於{subject}考試單選題，請選出正確的答案。\n\n"
SYSTEM_HEADER_DIRECT = "你是一位專業的中文AI助理，以下是關於{subject}考試單選題，請直接選出正確的答案。"
USER_HEADER_DIRECT = "以下是關於{subject}考試單選題，請直接選出正確的答案。\n\n"
INSTRUCT_OPENING = "[INST] 以下是關於{subject}考試單選題，請選出正確的答案\n\n [/INST]好的，我會結合{subject}相關知識回答"
INSTRUCT_STEPS = "答案：讓我們一步一步思考，\n1."
INSTRUCT_STEPS_PROMPTED = "答案是什麼？讓我們一步一步思考，\n1."

# Role tokens used when a model has no template row.
CHATML_TOKENS = {
    "system": "<|im_start|>system\n",
    "user": "<|im_start|>user\n",
    "assistant": "<|im_start|>assistant\n",
    "end": "<|im_end|>",
}
# Turn markers of the Human/AI transcript style.
TURN_MARKERS = {"human": "\n\nHuman:", "ai": "\n\nAssistant:"}

# --- fixed values: default exam: supercategory -> categories -----------------

HIERARCHY = {
    "STEM": ["physics", "chemistry", "biology", "computer science", "math", "engineering"],
    "humanities": ["history", "philosophy", "law"],
    "social sciences": ["politics", "culture", "economics", "geography", "psychology", "education"],
    "other (business, health, misc.)": ["other", "business", "health"],
}

# --- fixed values: subjects (subject | display name | category) --------------
# The default exam lists one subject that is not set as a task.

UNSET_SUBJECTS = ["linear_algebra"]

TRADITIONAL_SUBJECTS = """\
dentistry | 牙醫學 | health
traditional_chinese_medicine_clinical_medicine | 中醫臨床醫學 | health
clinical_psychology | 臨床心理學 | psychology
technical | 技術工相關 | other
culinary_skills | 餐旅 | other
mechanical | 機械與機電概論 | other
logic_reasoning | 邏輯思維 | other
real_estate | 房地產 | other
general_principles_of_law | 法學大意 | law
finance_banking | 金融與法規 | business
anti_money_laundering | 洗錢防制 | law
ttqav2 | 台灣在地用語 | culture
marketing_management | 行銷管理 | other
business_management | 企業管理 | other
organic_chemistry | 有機化學 | chemistry
advance_chemistry | 化學 | chemistry
physics | 物理 | physics
secondary_physics | 高中物理 | physics
human_behavior | 人類行為與社會 | psychology
national_protection | 軍事 | politics
jce_humanities | 指考人文科目 | philosophy
linear_algebra | 線代 | math
politic_science | 政治 | politics
agriculture | 農業 | other
official_document_management | 機關文書 | other
financial_analysis | 財務分析 | business
pharmacy | 藥劑學 | biology
educational_psychology | 教育心理 | psychology
statistics_and_machine_learning | 統計與機器學習 | engineering
management_accounting | 管理會計 | business
introduction_to_law | 法律概論 | law
computer_science | 資訊工程 | computer science
veterinary_pathology | 獸醫病理學 | health
accounting | 會計學 | business
fire_science | 火災學 | other
optometry | 視光學 | other
insurance_studies | 保險學 | other
pharmacology | 藥理學 | health
taxation | 稅務 | law
education_(profession_level) | 教育專業 | education
economics | 經濟學 | economics
veterinary_pharmacology | 獸醫藥理學 | health
nautical_science | 航海 | other
occupational_therapy_for_psychological_disorders | 心理障礙職能治療學 | psychology
trust_practice | 信託實務 | law
geography_of_taiwan | 台灣地理 | geography
physical_education | 體育 | education
auditing | 審計學 | business
administrative_law | 行政法 | law
basic_medical_science | 基礎醫學 | biology
macroeconomics | 總經 | economics
trade | 貿易 | business
chinese_language_and_literature | 國文 | culture
tve_design | 統測＿設計 | other
junior_science_exam | 國中會考基測自然科 | biology
junior_math_exam | 國中會考基測數學科 | math
junior_chinese_exam | 國中會考基測國文 | culture
junior_social_studies | 國中會考基測社會科 | other
tve_mathematics | 統測數學 | math
tve_chinese_language | 統測國文 | culture
tve_natural_sciences | 統測自然科 | biology
junior_chemistry | 國中理化 | chemistry
music | 音樂科 | other
education | 教育常識 | education
three_principles_of_people | 三民主義 | culture
taiwanese_hokkien | 閩南語 | culture
engineering_math | 工程數學 | math
"""

MAINLAND_SUBJECTS = """\
agronomy | 农学 | Other
anatomy | 解剖学 | STEM
ancient_chinese | 古汉语 | specific
arts | 艺术学 | Humanities
astronomy | 天文学 | STEM
business_ethics | 商业伦理 | Science
chinese_civil_service_exam | 中国公务员考试 | specific
chinese_driving_rule | 中国驾驶规则 | specific
chinese_food_culture | 中国饮食文化 | specific
chinese_foreign_policy | 中国外交政策 | specific
chinese_history | 中国历史 | specific
chinese_literature | 中国文学 | specific
chinese_teacher_qualification | 中国教师资格 | specific
clinical_knowledge | 临床知识 | STEM
college_actuarial_science | 大学精算学 | STEM
college_education | 大学教育学 | Science
college_engineering_hydrology | 大学工程水文学 | STEM
college_law | 大学法律 | Humanities
college_mathematics | 大学数学 | STEM
college_medical_statistics | 大学医学统计 | STEM
college_medicine | 大学医学 | STEM
computer_science | 计算机科学 | STEM
computer_security | 计算机安全 | STEM
conceptual_physics | 概念物理学 | STEM
construction_project_management | 建设工程管理 | specific
economics | 经济学 | Science
education | 教育学 | Science
electrical_engineering | 电气工程 | STEM
elementary_chinese | 小学语文 | specific
elementary_commonsense | 小学常识 | specific
elementary_information_and_technology | 小学信息技术 | Other
elementary_mathematics | 初等数学 | STEM
ethnology | 民族学 | specific
food_science | 食品科学 | Other
genetics | 遗传学 | STEM
global_facts | 全球事实 | Humanities
high_school_biology | 高中生物 | STEM
high_school_chemistry | 高中化学 | STEM
high_school_geography | 高中地理 | Science
high_school_mathematics | 高中数学 | STEM
high_school_physics | 高中物理学 | STEM
high_school_politics | 高中政治 | specific
human_sexuality | 人类性行为 | Other
international_law | 国际法学 | Humanities
journalism | 新闻学 | Science
jurisprudence | 法理学 | Humanities
legal_and_moral_basis | 法律与道德基础 | Other
logical | 逻辑学 | Humanities
machine_learning | 机器学习 | STEM
management | 管理学 | Science
marketing | 市场营销 | Science
marxist_theory | 马克思主义理论 | Humanities
modern_chinese | 现代汉语 | specific
nutrition | 营养学 | STEM
philosophy | 哲学 | Humanities
professional_accounting | 专业会计 | Science
professional_law | 专业法学 | Humanities
professional_medicine | 专业医学 | STEM
professional_psychology | 专业心理学 | Science
public_relations | 公共关系 | Science
security_study | 安全研究 | Science
sociology | 社会学 | Science
sports_science | 体育学 | Other
traditional_chinese_medicine | 中医中药 | specific
virology | 病毒学 | STEM
world_history | 世界历史 | Humanities
world_religions | 世界宗教 | Humanities
"""

LEVELS_SUBJECTS = """\
computer_network | 计算机网络 | STEM
operating_system | 操作系统 | STEM
computer_architecture | 计算机组成 | STEM
college_programming | 大学编程 | STEM
college_physics | 大学物理 | STEM
college_chemistry | 大学化学 | STEM
advanced_mathematics | 高等数学 | STEM
probability_and_statistics | 概率统计 | STEM
discrete_mathematics | 离散数学 | STEM
electrical_engineer | 注册电气工程师 | STEM
metrology_engineer | 注册计量师 | STEM
high_school_mathematics | 高中数学 | STEM
high_school_physics | 高中物理 | STEM
high_school_chemistry | 高中化学 | STEM
high_school_biology | 高中生物 | STEM
middle_school_mathematics | 初中数学 | STEM
middle_school_biology | 初中生物 | STEM
middle_school_physics | 初中物理 | STEM
middle_school_chemistry | 初中化学 | STEM
veterinary_medicine | 兽医学 | STEM
college_economics | 大学经济学 | Social Science
business_administration | 工商管理 | Social Science
marxism | 马克思主义基本原理 | Social Science
mao_zedong_thought | 毛泽东思想和中国特色社会主义理论体系概论 | Social Science
education_science | 教育学 | Social Science
teacher_qualification | 教师资格 | Social Science
high_school_politics | 高中政治 | Social Science
high_school_geography | 高中地理 | Social Science
middle_school_politics | 初中政治 | Social Science
middle_school_geography | 初中地理 | Social Science
modern_chinese_history | 近代史纲要 | Humanities
ideological_and_moral_cultivation | 思想道德修养与法律基础 | Humanities
logic | 逻辑学 | Humanities
law | 法学 | Humanities
chinese_language_and_literature | 中国语言文学 | Humanities
art_studies | 艺术学 | Humanities
professional_tour_guide | 导游资格 | Humanities
legal_professional | 法律职业资格 | Humanities
high_school_chinese | 高中语文 | Humanities
high_school_history | 高中历史 | Humanities
middle_school_history | 初中历史 | Humanities
civil_servant | 公务员 | Other
sports_science | 体育学 | Other
plant_protection | 植物保护 | Other
basic_medicine | 基础医学 | Other
clinical_medicine | 临床医学 | Other
urban_and_rural_planner | 注册城乡规划师 | Other
accountant | 注册会计师 | Other
fire_engineer | 注册消防工程师 | Other
environmental_impact_assessment_engineer | 环境影响评价工程师 | Other
tax_accountant | 税务师 | Other
physician | 医师资格 | Other
"""

# --- fixed values: role tokens per model --------------------------------------
# ``\n`` stays two characters, and a repeated model name keeps its first row.

MODEL_TEMPLATES_CSV = r"""model_name,systemMessageToken,messageEndToken,assistantMessageToken,userMessageToken
deepseek-ai/deepseek-llm-7b-chat,,\n\n,Assistant:,User:
deepseek-ai/deepseek-coder-6.7b-instruct,,\n<|EOT|>\n,### Response:\n,### Instruction:\n
deepseek-ai/deepseek-llm-67b-base,,\n\n,\n答案：,
CausalLM/14B,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
CausalLM/7B,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
CausalLM/7B-DPO-alpha,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
Skywork/Skywork-13B-Math,,\n\n,\n答案：,
Skywork/Skywork-13B-base,,\n\n,\n答案：,
baichuan-inc/Baichuan2-7B-Base,,\n\n,\n答案：,
baichuan-inc/Baichuan2-7B-Chat,<reserved_106>,<|im_end|>,<reserved_107>,<reserved_106>
bigscience/bloomz-7b1,,\n\n,\n答案：,
GeneZC/MiniChat-3B,<s> [|User|] ,</s>,[|Assistant|],<s> [|User|] 
yentinglin/Taiwan-LLM-7B-v2.1-chat,,</s>, ASSISTANT: , USER: 
LinkSoul/Chinese-Llama-2-7b,[INST] <<SYS>>\n,\n,[/INST],<</SYS>>\n\n
hfl/chinese-llama-2-13b-16k,,\n\n,### Response:\n,### Instruction:\n
hfl/chinese-llama-2-7b-16k,,\n\n,### Response:\n,### Instruction:\n
hfl/chinese-llama-2-7b,,\n\n,### Response:\n,### Instruction:\n
hfl/chinese-llama-2-lora-13b-16k,,\n\n,### Response:\n,### Instruction:\n
microsoft/Orca-2-13b,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
01-ai/Yi-34B,,\n\n,\n答案：,
01-ai/Yi-6B,,\n\n,\n答案：,
01-ai/Yi-9B,,\n\n,\n答案：,
01-ai/Yi-34B-Chat,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
01-ai/Yi-6B-Chat,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
yentinglin/Taiwan-LLM-13B-v2.0-chat,,</s>, ASSISTANT: , USER: 
yentinglin/Taiwan-LLM-13B-v2.0-base,,\n\n,\n答案：,
yentinglin/Taiwan-LLM-7B-v2.0-base,,\n\n,\n答案：,
MediaTek-Research/Breeze-7B-Instruct-v0_1,<s>, ,[/INST] ,[INST] 
MediaTek-Research/Breeze-7B-Instruct-v1_0,<s>, ,[/INST] ,[INST] 
deepseek-ai/deepseek-llm-67b-base,,\n\n,\n答案：,
deepseek-ai/deepseek-llm-67b-chat,,<｜end▁of▁sentence｜>, ASSISTANT: , USER: 
deepseek-ai/deepseek-llm-7b-base,,\n,\n答案：,
deepseek-ai/deepseek-llm-7b-chat,,<｜end▁of▁sentence｜>, ASSISTANT: , USER: 
Qwen/Qwen-72B-Chat,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
Qwen/Qwen-72B,,\n\n,\n答案：,
Qwen/Qwen-7B-Chat,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
Qwen/Qwen-1_8B,,\n\n,\n答案：,
Qwen/Qwen-1_8B-Chat,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
vivo-ai/BlueLM-7B-Chat-32K,,\n,[|AI|]:,[|Human|]:
vivo-ai/BlueLM-7B-Base,,\n\n,\n答案：,
vivo-ai/BlueLM-7B-Chat,,\n,[|AI|]:,[|Human|]:
TigerResearch/tigerbot-70b-chat-v2,,\n\n,### Response:\n,### Instruction:\n
TigerResearch/tigerbot-70b-base,,\n\n,\n答案：,
TigerResearch/tigerbot-70b-base-v2,,\n\n,\n答案：,
TigerResearch/tigerbot-13b-base,,\n\n,\n答案：,
TigerResearch/tigerbot-13b-chat-v3,,\n\n,### Response:\n,### Instruction:\n
TigerResearch/tigerbot-13b-chat,,\n\n,### Response:\n,### Instruction:\n
TigerResearch/tigerbot-7b-base,,\n\n,\n答案：,
TigerResearch/tigerbot-7b-chat,,\n\n,### Response:\n,### Instruction:\n
internlm/internlm-7b,,\n\n,\n答案：,
internlm/internlm-chat-7b,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
internlm/internlm2-chat-7b,<|im_start|>system\n,<|im_end|>,<|im_start|>assistant\n,<|im_start|>user\n
THUDM/chatglm3-6b,<|system|>, ,<|assistant|>,<|user|>
THUDM/chatglm2-6b,,\n\n,答：,问：
LinkSoul/Chinese-Llama-2-7b,,</s>,[/INST],[INST]
hongyin/mistral-7b-80k,,\n,\n答案：,问题：
OpenBuddy/openbuddy-mistral-7b-v13.1,,\n,Assistant: , User: 
OpenBuddy/openbuddy-zephyr-7b-v14.1,,\n,Assistant: , User: 
Azure99/blossom-v3_1-mistral-7b,,\n,|Bot|:,|Human|: 
SUSTech/SUS-Chat-34B,,\n\n,### Assistant:,### Human: 
FlagAlpha/Atom-7B,,\n,\n答案：,问题：
hfl/chinese-alpaca-2-7b,[INST] <<SYS>>\n,[/INST],[INST],
"""
