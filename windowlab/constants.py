"""Fixed values of the measured network: metric lists, scenario labels, patterns, tolerances.

They are parameters of the operators, which run on any other column list as well.
"""

# Scenario directory -> defense active.
SCENARIOS = {"baseline": 0, "attack_only": 0, "defense_only": 1, "defense_vs_attack": 1}

# The 33 metrics of one window.
METRICS = [
    "TcMessageRate", "MidMessageRate", "HnaMessageRate",
    "AverageAdvertisedLinksPerTCMessage",
    "NormalizedRoutingLoad", "RoutingOverheadRatio", "RoutingOverheadBytesRatio",
    "PacketDeliveryRatio", "PacketLossRatio", "AverageEndToEndDelay", "AverageJitter",
    "Throughput", "AverageHopCount", "DataPacketRate", "RxTxPacketRatio",
    "FlowCount", "AvgFlowDuration", "FlowDurationStd", "AvgFlowThroughput",
    "AvgFlowDelay", "AvgFlowJitter", "AvgFlowLossRate", "FlowThroughputStd",
    "FlowDelayStd", "FlowJitterStd", "FlowLossRateStd",
    "AvgTxBytesPerFlow", "AvgRxBytesPerFlow", "AvgTxPacketsPerFlow", "AvgRxPacketsPerFlow",
    "AvgTxPacketSize", "AvgRxPacketSize",
    "AverageMprCount",
]

# Metrics named in the report, and those a passive listener can observe.
REPORT_METRICS = [
    "PacketDeliveryRatio", "PacketLossRatio", "AverageEndToEndDelay", "AverageJitter",
    "Throughput", "AverageHopCount",
    "NormalizedRoutingLoad", "RoutingOverheadRatio", "AverageAdvertisedLinksPerTCMessage",
    "TcMessageRate", "MidMessageRate",
    "HnaMessageRate", "DataPacketRate", "CDR", "TDR",
]
OBSERVABLE_METRICS = [
    "PacketDeliveryRatio", "PacketLossRatio", "AverageEndToEndDelay", "AverageJitter",
    "Throughput", "AverageHopCount",
    "TcMessageRate", "MidMessageRate",
    "HnaMessageRate", "DataPacketRate", "CDR", "TDR",
]
FEATURE_SETS = {"full": METRICS, "report": REPORT_METRICS, "observable": OBSERVABLE_METRICS}

# The delay and jitter family, the universal four, the features of largest shift.
DJ_FEATURES = [
    "AverageEndToEndDelay", "AverageJitter",
    "AvgFlowDelay", "AvgFlowJitter",
    "FlowDelayStd", "FlowJitterStd",
]
UNIVERSAL_4 = [
    "AverageAdvertisedLinksPerTCMessage",
    "AverageMprCount",
    "DataPacketRate",
    "FlowThroughputStd",
]
TOP6_SHIFT = [
    "FlowThroughputStd", "AvgFlowThroughput", "FlowCount",
    "TcMessageRate", "AvgTxPacketsPerFlow", "NormalizedRoutingLoad",
]
TOP6_SHIFT_NO_U4 = [
    "AvgFlowThroughput", "FlowCount", "TcMessageRate",
    "AvgTxPacketsPerFlow", "NormalizedRoutingLoad", "AvgRxPacketsPerFlow",
]

# Features with power terms, and the pairs that interact.
POWER_METRICS = ["Throughput", "AverageEndToEndDelay", "AverageJitter", "RoutingOverheadRatio"]
CRITICAL_PAIRS = [
    ("Throughput", "AverageEndToEndDelay"),
    ("PacketDeliveryRatio", "PacketLossRatio"),
    ("RoutingOverheadRatio", "NormalizedRoutingLoad"),
    ("AverageEndToEndDelay", "AverageJitter"),
    ("Throughput", "RoutingOverheadRatio"),
]

# Leave-out sets of the ablation; the random controls are drawn by hash (seeds below).
ABLATION_SETS = {
    "Standard_33": [],
    "LOO_AvgE2EDelay": ["AverageEndToEndDelay"],
    "LOO_AvgJitter": ["AverageJitter"],
    "LOO_AvgFlowDelay": ["AvgFlowDelay"],
    "LOO_AvgFlowJit": ["AvgFlowJitter"],
    "LOO_FlowDelayStd": ["FlowDelayStd"],
    "LOO_FlowJitterStd": ["FlowJitterStd"],
    "DJ_minus2_Flow_extremes": ["FlowDelayStd", "FlowJitterStd"],
    "DJ_minus2_Avg_only": ["AverageEndToEndDelay", "AverageJitter"],
    "DJ_minus4_Flow_only": ["AvgFlowDelay", "AvgFlowJitter", "FlowDelayStd", "FlowJitterStd"],
    "DJ_minus6_all": DJ_FEATURES,
    "Top6_dShift_nonDJ": TOP6_SHIFT,
    "Top6_dShift_nonDJ_nonU4": TOP6_SHIFT_NO_U4,
}
RANDOM_REMOVAL_SEEDS = [1001, 2002, 3003, 4004]

# Ordered classes of attempt logs.
LOG_RULES = [
    ("attacker_unavailable", r"(?i)Attacker not available\.\s*\*+\s*Terminated"),
    ("connectivity_failed", r"(?i)Assert connectivity failed"),
    ("neighbor_abort", r"(?i)Sending node of udp packets is a neighbor"),
]

# Ordered keyword classes of removed features (matched on the lower-case name).
FEATURE_CATEGORIES = [
    ("delay/jitter related", "delay|jitter"),
    ("loss-rate related", "loss"),
    ("flow-count/duration related", "flowcount|duration|flowdur"),
    ("energy/MAC related", "energy|mac|drop"),
    ("row_*/aggregate stats", "^row_"),
]

# Thresholds, tolerances and axes of the experiments.
THRESHOLD_GRID = (10, 90)          # hundredths, both ends included
VARIANCE_FLOOR = 0.01
CORRELATION_CUT = 0.95
STABILITY_THRESHOLDS = [0.6, 0.7, 0.8, 0.9]
FEWSHOT_RUNS = [25, 50, 100, 250, 500]
ISOTONIC_MIN_RUNS = 250
SEEDS = list(range(42, 62))
TARGET_TEST_SIZE = 0.40
PLATEAU = 0.99
NOISE_BAND = 0.005
BASELINE_REFERENCE = {"SM": 0.6718, "MS": 0.8425}
BASELINE_TOLERANCE = 0.01

# Tuned parameters a model accepts from the search, by family.
ALLOWED_PARAMS = {
    "catboost": ["iterations", "learning_rate", "depth", "l2_leaf_reg", "border_count",
                 "bagging_temperature", "random_strength", "subsample"],
}
