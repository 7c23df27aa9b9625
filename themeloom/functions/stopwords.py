"""Words that never become keywords."""

# The stop list, grouped by kind, in its given order.
STOP_WORDS = tuple(
    """
公司 主营 业务 产品 行业 市场 技术 服务 领域
发展 应用 系统 设备 生产 客户 研发 解决方案
全球 国内 企业 创新 平台 管理 体系
能力 价值 品质 质量 单位 材料 方案
建设 投资 资产 装备 工程 规模 优势
实现 提供 中国 国家 区域 股份 集团
处理 数据 流程 效率 成本 一体化
龙头 概念 板块 题材 潜力股 科技股 成长股
绩优股 蓝筹股 白马股 次新股 妖股
涨停 跌停 复牌 停牌 增发 配股 回购
上市公司 控股公司 股份公司 子公司
知名企业 品牌优势 品牌价值 品牌效应
技术实力 技术优势 技术壁垒 核心技术
产业布局 产业链 产业集群 产业升级
主导产品 主打产品 拳头产品 核心产品
竞争优势 竞争力 市场份额 市场地位
盈利能力 盈利模式 商业模式 经营模式
战略布局 战略规划 战略合作 战略投资
公司业绩 业绩增长 营业收入 净利润
性能指标 性能需求 机械性能 电性能
高增值 高值 高智能 高精度 高效率
物理 全场景 数字化 智能化 一致性 冗余
基座 分发 链路 资产保值 一致性能
数智化 极精 极致 极简 物性 表征
无人化 留证 演进 位势 统治 赋能
产能 产量 项目 基地 工厂 园区
国产 进口 出口 贸易 销售 采购
上游 下游 终端 渠道 供应 需求
机型 型号 产线 工艺 制造
能源行业 电力行业 电子行业 化工行业
制造业 金融行业 房地产 农业
电力企业 电力公司 能源供应 能源需求
能源建设 能源动力 能源管理 能源部 核能源
能源技术 能源价格
智能型 智能工具 商业智能 智能机
机电产品
""".split()
)
