"""Vocabularies that results depend on. All are defaults of parameters."""

ENTITY_TYPES = ("METHOD", "CONCEPT", "DOMAIN", "FINDING", "DATASET", "METRIC", "PAPER", "CONSTRAINT")
PREDICATES = ("USES_METHOD", "PROPOSES", "APPLIES_TO", "ACHIEVES", "REQUIRES_RESOURCE", "REQUIRES_DATA", "IMPROVES", "CONTRADICTS", "EXTENDS", "EVALUATED_ON", "HAS_CONSTRAINT", "DISCUSSES", "INFEASIBLE_FOR", "CORRELATES_WITH")
# markers of fact extraction, in the order in which they win
EXTRACT_CAUSAL = ("causes", "leads to", "results in", "because", "therefore", "consequently", "due to", "effect of", "contributes to", "enables", "prevents", "inhibits", "increases", "decreases", "improves", "enhances", "reduces", "facilitates")
EXTRACT_CONTRADICTION = ("however", "contradicts", "in contrast", "whereas", "on the other hand", "inconsistent with", "conflicts with", "contrary to", "disputes", "challenges", "but", "despite", "nevertheless", "although", "while")
EXTRACT_EXTENSION = ("extends", "builds upon", "based on", "inspired by", "modification of", "variant of", "generalization of", "adaptation of", "improvement over", "evolution of")
# markers of relation classification
CLASSIFY_CAUSAL = ("causes", "leads to", "results in", "because", "therefore", "consequently", "due to", "effect of", "contributes to", "enables", "prevents", "inhibits")
CLASSIFY_CONTRADICTION = ("however", "contradicts", "in contrast", "whereas", "on the other hand", "inconsistent with", "conflicts with", "contrary to", "disputes", "challenges")
CLASSIFY_EXTENSION = ("extends", "builds upon", "based on", "inspired by", "modification of", "improvement over")
APPROACH_TERMS = ("quantitative", "qualitative", "mixed methods", "survey", "experiment", "case study", "meta-analysis", "systematic review", "simulation", "deep learning", "machine learning", "statistical", "interview")
ASPECT_TERMS = ("effectiveness", "efficiency", "scalability", "usability", "reliability", "validity", "generalizability", "reproducibility", "equity", "accessibility", "cost", "implementation", "ethical", "privacy", "security", "sustainability")
QUERY_EXPANSIONS = (
    ("cnn", "convolutional neural network"),
    ("rnn", "recurrent neural network"),
    ("nlp", "natural language processing"),
    ("llm", "large language model"),
    ("gan", "generative adversarial network"),
    ("object detection", "object recognition localization"),
    ("attention", "attention mechanism transformer"),
    ("transformer", "attention mechanism"),
    ("optimization", "training optimization gradient"),
    ("edge", "edge device mobile resource-constrained"),
    ("compression", "model compression distillation quantization"),
    ("image recognition", "image classification computer vision"),
)
SECTION_WORDS = (
    "abstract", "abstrak", "introduction", "pendahuluan", "background", "related work", "literature review", "tinjauan pustaka", "landasan teori", "method", "methods", "methodology", "metode", "metodologi",
    "materials and methods", "approach", "proposed", "model", "experiment", "experiments", "experimental", "eksperimen", "evaluation", "evaluasi", "result", "results", "hasil", "hasil dan pembahasan", "findings",
    "discussion", "pembahasan", "analysis", "analisis", "conclusion", "conclusions", "kesimpulan", "penutup", "limitation", "limitations", "keterbatasan", "future work", "acknowledgment", "acknowledgments",
    "acknowledgement", "references", "daftar pustaka", "bibliography", "appendix", "lampiran",
)
