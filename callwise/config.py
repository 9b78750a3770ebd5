"""Fixed values and default settings of the call domain."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

# The sentinel that stands for "no previous call".
FIRST_CALL = "PRIMERA_LLAMADA"

# The six target classes.
NEXT_STEPS = (
    "Aplazar lead",
    "Enviar documentación",
    "Agendar demo/reunión con especialista",
    "Escalar a manager del lead",
    "Cerrar lead - no interesado",
    "Esperar confirmación cliente",
)

# Two older classes that overlap and were merged into one.
MERGED_STEPS = {
    "Recontactar en X días": "Aplazar lead",
    "Cerrar lead - nurturing": "Aplazar lead",
}

# Texts that stand for a missing cell in a CSV file (pandas' default list).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Column roles of the call table.
CATEGORICAL = (
    "company_sector", "company_country", "company_city",
    "lead_source", "contact_role", "prev_next_step",
)
NUMERIC = (
    "company_num_employees", "company_annual_revenue_eur", "call_number",
    "days_since_entry", "days_since_last_call",
)

# Prior weight of each final status of a lead.
STATUS_PRIOR = {"Converted": 0.30, "Lost": 0.40, "Nurturing": 0.20, "In Progress": 0.10}

# Lead sources that move the prior.
INBOUND_SOURCES = ("Formulario web", "Referencia de cliente", "Inbound / Blog")
COLD_SOURCE = "Llamada en frío"

# What may follow each action
# (action, terminal, prob_terminal, terminal_status, days_lo, days_hi, outcome_summary).
ACTION_OUTCOMES = (
    ("Aplazar lead", False, 0.40, "nurturing", 10, 21,
     "El contacto necesita más tiempo. Lead pospuesto."),
    ("Enviar documentación", False, 0.0, None, 5, 14,
     "El contacto aceptó recibir documentación comercial."),
    ("Agendar demo/reunión con especialista", False, 0.30, "converted", 5, 10,
     "El contacto aceptó la demo. Se confirma fecha."),
    ("Escalar a manager del lead", False, 0.20, "converted", 7, 14,
     "Se coordina reunión con dirección del cliente."),
    ("Esperar confirmación cliente", False, 0.15, "converted", 7, 21,
     "El contacto está en proceso de aprobación interna."),
    ("Cerrar lead - no interesado", True, 1.0, "lost", 0, 0,
     "El contacto declina continuar. Lead cerrado como perdido."),
)

# What the two other strategies change
# (strategy, action, prob_terminal, days_lo, days_hi); None keeps the default.
STRATEGY_OVERRIDES = (
    ("aggressive", "Agendar demo/reunión con especialista", 0.50, None, None),
    ("aggressive", "Escalar a manager del lead", 0.35, None, None),
    ("aggressive", "Esperar confirmación cliente", 0.25, None, None),
    ("aggressive", "Aplazar lead", None, 3, 10),
    ("conservative", "Agendar demo/reunión con especialista", 0.15, None, None),
    ("conservative", "Escalar a manager del lead", 0.10, None, None),
    ("conservative", "Esperar confirmación cliente", 0.08, None, None),
    ("conservative", "Aplazar lead", None, 14, 30),
)

# Columns of the flat run index.
RUN_METRICS = (
    "accuracy", "f1_macro", "f1_weighted", "precision_macro", "precision_weighted",
    "recall_macro", "recall_weighted", "top3_accuracy", "brier_score_avg",
    "cv_f1_weighted_mean", "cv_f1_weighted_std",
)

# Search grids of the two tuned models.
PARAM_GRIDS = {
    "gradient_boosting": {
        "n_estimators": [100, 200, 300, 400],
        "max_depth": [3, 4, 5, 6, 7],
        "learning_rate": [0.05, 0.1, 0.15, 0.2],
        "subsample": [0.7, 0.8, 0.9],
        "colsample_bytree": [0.6, 0.7, 0.8, 0.9],
        "min_child_weight": [1, 3, 5, 7],
    },
    "random_forest": {
        "n_estimators": [100, 200, 300],
        "max_depth": [None, 5, 10, 15, 20],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2", None],
    },
}


@dataclass(frozen=True)
class Settings:
    """Settings an analysis may change."""

    sentinel: str = FIRST_CALL
    labels: tuple[str, ...] = NEXT_STEPS
    categorical: tuple[str, ...] = CATEGORICAL
    numeric: tuple[str, ...] = NUMERIC
    target: str = "next_step"
    embedding_dim: int = 384
    most_categories: int = 10_000
    test_size: Fraction = Fraction(1, 5)
    folds: int = 5
    seed: int = 42
    search_draws: int = 20
    booster: dict = field(default_factory=lambda: {
        "n_estimators": 300, "max_depth": 6, "learning_rate": 0.1,
        "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 3,
    })


DEFAULTS = Settings()
