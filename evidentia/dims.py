"""Rule data of the audit. The tables are small and fixed; they become literal expressions when a plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters with their display names and aliases.
PARAMS: dict[str, tuple[str, list[str]]] = {
    "learning_rate": ("Learning Rate", ["lr", "learning_rate", "learning rate", "learningrate", "base_lr", "eta", "init_lr", "initial_lr", "lr_init", "lrate", "learning_rate_init", "学习率"]),
    "batch_size": ("Batch Size", ["batch_size", "batch size", "batchsize", "batch", "bs", "train_batch_size", "per_device_train_batch_size", "n_rand", "mini_batch", "mini batch", "mini-batch", "minibatch", "批大小", "批量大小", "批量"]),
    "epochs": ("Epochs", ["epochs", "epoch", "num_epochs", "n_epochs", "n_epoch", "max_epochs", "num_train_epochs", "training epochs", "nb_epochs", "total_epochs", "迭代次数", "迭代轮数", "训练轮数", "轮次", "训练次数"]),
    "iterations": ("训练迭代次数", ["iterations", "iteration", "n_iter", "n_iters", "num_iter", "num_iters", "max_iter", "max_iters", "max_steps", "train_steps", "num_steps", "total_steps", "training steps", "iteration steps", "训练迭代", "迭代步数"]),
    "optimizer": ("Optimizer", ["optimizer", "optim", "solver", "优化器"]),
    "weight_decay": ("Weight Decay", ["weight_decay", "weight decay", "wd", "weightdecay", "l2_reg", "weight_decay_rate", "weight decay rate", "权重衰减"]),
    "momentum": ("Momentum", ["momentum", "beta1", "beta_1", "momentum_factor", "动量"]),
    "dropout": ("Dropout", ["dropout", "dropout_rate", "drop rate", "drop_prob", "drop"]),
    "seed": ("Random Seed", ["seed", "random_seed", "random seed", "manual_seed", "rng_seed", "random_state", "随机种子", "随机数种子"]),
    "dataset": ("Dataset", ["dataset", "data_set", "dataset_name", "dataset_version", "data", "数据集"]),
    "model": ("Model Architecture", ["model", "arch", "architecture", "backbone", "net", "模型", "model_name", "architecture_name", "backbone_name", "net_name", "model_type", "网络结构"]),
    "input_size": ("Input Size", ["input_size", "image_size", "img_size", "crop_size", "resolution", "输入尺寸", "图像尺寸"]),
    "warmup": ("Warmup", ["warmup", "warmup_epochs", "warmup_steps"]),
    "scheduler": ("LR Scheduler", ["scheduler", "lr_scheduler", "lr schedule", "学习率调度"]),
    "num_clusters": ("Cluster Count K", ["n_clusters", "num_clusters", "n clusters", "n_clusters_", "聚类数", "聚类个数", "簇数", "聚类簇数", "k值", "k 值"]),
    "threshold": ("Threshold", ["threshold", "thresh", "阈值", "判决阈值", "判定阈值", "判别阈值"]),
    "sigma_xy": ("水平定位标准差 σ", ["sigma_xy", "水平定位标准差", "水平坐标定位标准差", "水平误差标准差", "水平定位误差标准差"]),
    "sigma_z": ("深度定位标准差 σ_z", ["sigma_z", "深度定位标准差", "深度误差标准差", "深度定位误差标准差"]),
    "kill_radius": ("杀伤半径 R", ["kill_radius", "杀伤半径"]),
    "depth_est": ("深度定位值 h₀", ["depth_est", "深度定位值", "中心深度定位值", "深度估计值"]),
    "min_depth": ("深度下界 l", ["min_depth", "深度下界", "实际深度下界"]),
    "num_bombs": ("深弹数量", ["num_bombs", "投弹数量", "深弹数量", "深弹枚数"]),
}

# Least and largest plausible value, both inclusive, and whether it must be whole.
RANGES: dict[str, tuple[float, float, bool]] = {
    "learning_rate": (0.0, 1.0, False),
    "batch_size": (1, 1_000_000, True),
    "epochs": (1, 100_000, True),
    "iterations": (1, 100_000_000, True),
    "weight_decay": (0.0, 1.0, False),
    "momentum": (0.0, 1.0, False),
    "dropout": (0.0, 1.0, False),
    "warmup": (0, 100_000, True),
    "num_clusters": (2, 10_000, True),
    "threshold": (0.0, 1.0, False),
    "seed": (0, 2**63, True),
    "sigma_xy": (0.0, 100_000, False),
    "sigma_z": (0.0, 100_000, False),
    "kill_radius": (0.0, 10_000, False),
    "depth_est": (0.0, 12_000, False),
    "min_depth": (0.0, 12_000, False),
    "num_bombs": (1, 10_000, True),
    "input_size": (8, 2048, True),
}

# How much a mismatch of a parameter weighs; medium where none is named.
HIGH = ("learning_rate", "model", "num_clusters", "sigma_xy", "kill_radius", "num_bombs")
LOW = ("weight_decay", "momentum", "dropout", "warmup", "scheduler", "min_depth")

# Parameters whose value is a text, and those that a value patch may change.
TEXT_VALUED = ("optimizer", "scheduler", "dataset", "model")
PATCHABLE = ("learning_rate", "batch_size", "epochs", "iterations", "weight_decay", "dropout", "warmup", "input_size", "momentum", "seed", "threshold", "dataset")
PENALTY = {"high": 15, "medium": 8, "low": 3, "none": 0}
RISK_ORDER = {"high": 0, "medium": 1, "low": 2, "none": 3}

# Languages by file extension.
LANGUAGES = {
    ".m": "MATLAB", ".r": "R", ".jl": "Julia", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C/C++头文件", ".cu": "CUDA",
    ".java": "Java", ".f90": "Fortran", ".f": "Fortran", ".sh": "Shell", ".bash": "Shell", ".ps1": "PowerShell", ".yaml": "YAML",
    ".yml": "YAML", ".ini": "INI", ".cfg": "INI", ".toml": "TOML", ".txt": "文本配置",
}

# Optimizer and scheduler classes with the name they are compared by.
OPTIMIZER_CLASSES = {
    "Adam": "adam", "AdamW": "adamw", "SGD": "sgd", "RMSprop": "rmsprop", "Adagrad": "adagrad", "AdaDelta": "adadelta", "Adamax": "adamax",
    "Lamb": "lamb", "NAdam": "nadam", "AdamOptimizer": "adam", "AdamWeightDecayOptimizer": "adam", "GradientDescentOptimizer": "sgd",
    "MomentumOptimizer": "sgd", "RMSPropOptimizer": "rmsprop", "AdagradOptimizer": "adagrad", "AdadeltaOptimizer": "adadelta", "FtrlOptimizer": "ftrl",
}
SCHEDULER_CLASSES = {
    "CosineAnnealingLR": "cosine annealing", "CosineAnnealingWarmRestarts": "cosine annealing", "StepLR": "step lr", "MultiStepLR": "multistep",
    "ExponentialLR": "exponential", "ReduceLROnPlateau": "plateau", "ExponentialDecay": "exponential", "PolynomialDecay": "polynomial",
    "CosineDecay": "cosine annealing", "WarmUpCosineDecay": "cosine annealing",
}

# Calls that fix a seed, as dotted names.
SEED_CALLS = (
    "torch.manual_seed", "torch.manual_seed_all", "random.seed", "seed", "np.random.seed", "numpy.random.seed", "tf.random.set_seed",
    "torch.cuda.manual_seed", "torch.cuda.manual_seed_all", "pl.seed_everything", "set_seed", "seed_everything", "np.random.default_rng",
    "numpy.random.default_rng", "default_rng", "np.random.RandomState", "numpy.random.RandomState", "RandomState",
)


def plain_name(name: str) -> str:
    """Trimmed, lower case, without a leading ``args.``, separators as single spaces."""
    name = re.sub(r"^args\.", "", name.strip().lower())
    return re.sub(r"[\s_-]+", " ", name).strip()


ALIASES: dict[str, str] = {}
for _key, (_, _names) in PARAMS.items():
    for _name in [_key, *_names]:
        ALIASES.setdefault(plain_name(_name), _key)


def lookup(column: Column, table: dict[str, object], default: object = None) -> Column:
    """A dictionary as a map literal: one hash probe a row, no join."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, F.lit(default))


def importance(key: Column) -> Column:
    return F.when(key.isin(*HIGH), "high").when(key.isin(*LOW), "low").otherwise("medium")


def category(key: Column) -> Column:
    return F.when(key.startswith("result_"), "result").when(key == "dataset", "data").otherwise("param")


def display_name(key: Column) -> Column:
    return F.coalesce(lookup(key, {k: d for k, (d, _) in PARAMS.items()}), key)


def dim_param(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d, k in TEXT_VALUED, k in PATCHABLE) for k, (d, _) in PARAMS.items()], "key string, display string, text_valued boolean, patchable boolean")


def dim_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ALIASES.items()), "alias string, key string")
