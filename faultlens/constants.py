"""Fixed values that must equal the studied pipeline's conventions."""

# Fault classes 0..7 in code order.
FAULT_NAMES = ["healthy", "memeater", "memleak", "membw", "cpuoccupy",
               "cachecopy", "iometadata", "iobandwidth"]

# Application codes and names.
APP_NAMES = {0: "idle", 20: "Kripke", 21: "AMG", 22: "Nekbone", 23: "PENNANT", 24: "HPL"}

# Label columns of a node table (never treated as metrics).
LABEL_COLUMNS = ["experiment/applicationLabel", "applicationLabel",
                 "applicationConfigLabel", "busyLabel", "faultPred", "faultLabel"]

# Window statistics, in output order, for the 6- and 11-statistic sets.
STATS_6 = ["mean", "std", "perc25", "perc75", "sumdiff", "last"]
STATS_11 = ["mean", "std", "perc5", "perc25", "perc75", "perc95", "sumdiff",
            "last", "min", "max", "median"]

# Percentile statistic -> fraction.
PERCENTILES = {"perc5": 0.05, "perc25": 0.25, "median": 0.5, "perc75": 0.75, "perc95": 0.95}

# Score table metric names.
SCORE_METRICS = ["f1", "sensitivity", "specificity", "fp_rate", "fn_rate"]

# Feature-list reader messages.
MSG_N_TOO_LOW = "n parameter is lower than 1 (it is {n})"
MSG_EMPTY = "{path} is empty"
MSG_MISSING = "{path} does not exist"
