"""Labels and the patterns that stand for them in papers on radiology report models.

They must match what existing tables were made with, so they are stated as they
are. All are defaults of parameters.
"""

DATASETS = {
    "MIMIC-CXR": [r"\bmimic[- ]?cxr\b"],
    "IU X-ray": [r"\biu[- ]?x[- ]?ray\b", r"\bopen[- ]?i\b"],
    "CheXpert": [r"\bchexpert\b"],
    "NIH ChestX-ray14": [r"\b(chestx[- ]?ray14|nih[- ]?14|nih chestx[- ]?ray14)\b"],
    "CXR-RePaiR": [r"\bcxr[- ]?repair\b"],
    "RSNA Pneumonia": [r"\brsna pneumonia\b"],
}
PAIRED_DATASETS = ("MIMIC-CXR", "IU X-ray", "CXR-RePaiR", "CheXpert")
PAIRED_PHRASES = [r"\bpaired (image[- ]text|image[- ]report|image[- ]caption)\b", r"\bimage[- ]report pairs?\b", r"\bpaired data(set)?\b"]
REPORT_WORDS = [r"\breport(s)?\b", r"\bcaption(s)?\b", r"\btext\b"]
TRAIN_WORDS = [r"\btrain(ing)?\b", r"\bpretrain(ing)?\b", r"\bfine[- ]?tune(d|ing)?\b"]
EVAL_WORDS = [r"\b(eval(uate|uation)?|test|validation|val)\b"]
FAMILIES = {
    "ALBEF": [r"\balbef\b"],
    "BLIP": [r"\bblip\b(?!-?2)"],
    "BLIP-2": [r"\bblip[- ]?2\b", r"\binstruct[- ]?blip\b"],
    "Flamingo": [r"\bflamingo\b"],
    "LLaVA": [r"\bllava(\s*[-]?\s*med|\s*1\.5)?\b"],
    "MiniGPT-4": [r"\bminigpt[- ]?4\b"],
    "XrayGPT": [r"\bxraygpt\b"],
    "Qwen-VL": [r"\bqwen[- ]?vl\b"],
    "CheXNet": [r"\bchexnet\b"],
    "TrMRG": [r"\btrmrg\b", r"\bme[- ]?transformer\b"],
}
VLM_FAMILIES = ("ALBEF", "BLIP", "BLIP-2", "Flamingo", "LLaVA", "MiniGPT-4", "XrayGPT", "Qwen-VL")
VISION = {
    "ViT": [r"\bvit\b", r"\bvision transformer\b", r"\bvit[- ]?(b|l|h)/?(14|16)?\b"],
    "CLIP": [r"\bclip\b", r"\bclip (vit|resnet)\b"],
    "ResNet50": [r"\bresnet[- ]?50\b"],
    "CNN": [r"\bcnn\b", r"\bconvolution(al)?\b"],
    "Swin": [r"\bswin[- ]?transformer\b"],
    "ConvNeXt": [r"\bconvnext\b"],
}
LANGUAGE = {
    "LLaMA": [r"\bllama(-\d+b)?\b", r"\bmeta[- ]?llama\b", r"\bllama[- ]?(2|3)\b"],
    "Vicuna": [r"\bvicuna\b"],
    "GPT-2": [r"\bgpt[- ]?2\b"],
    "GPT-3": [r"\bgpt[- ]?3(\.5)?\b"],
    "BioGPT": [r"\bbiogpt\b"],
    "T5": [r"\bt5\b"],
    "BERT": [r"\bbert\b"],
    "Transformer": [r"\btransformer\b(?! with)"],
    "LSTM": [r"\blstm\b"],
    "GRU": [r"\bgru\b"],
}
FUSION = {"cross-attention": [r"\bcross[- ]attention\b"], "conditioned": [r"\bcondition(ed|ing)\b"], "co-attention": [r"\bco[- ]attention\b"]}
OBJECTIVES = {"ITM": [r"\bimage[- ]?text matching\b", r"\bitm\b"], "contrastive": [r"\bcontrastive\b"], "coverage": [r"\bcoverage\b"]}
METRICS = {
    "BLEU": [r"\bbleu(\d*)?\b", r"\bbleu[- ]?(1|2|3|4)\b"],
    "CIDEr": [r"\bcider\b"],
    "METEOR": [r"\bmeteor\b"],
    "ROUGE": [r"\brouge(-[l1-9])?\b", r"\brouge[- ]?l\b"],
    "BERTScore": [r"\bbertscore\b"],
    "BLEURT": [r"\bbleurt\b"],
    "SPICE": [r"\bspice\b"],
    "RadGraph": [r"\bradgraph\b"],
    "RadCliQ": [r"\bradcliq\b"],
    "GLEU": [r"\bgleu\b"],
    "Accuracy": [r"\baccuracy\b"],
    "F1": [r"\bf1\b"],
    "AUC": [r"\bauc\b"],
}
RAG = [r"\bretrieval[- ]?augmented\b", r"\bRAG\b", r"\bretriever\b", r"\bfaiss\b", r"\bBM25\b", r"\bvector (index|store)\b", r"\bdpr\b", r"\bmemory (bank|module)\b"]
VLM_PHRASES = [r"\bvision[- ]language\b", r"\bmulti[- ]modal\b"]
MODALITIES = {
    "X-Ray": [r"\bchest x-?ray(s)?\b", r"\bcxr\b", r"\bradiograph(s)?\b"],
    "CT": [r"\bct\b", r"\bcomputed tomography\b"],
    "MRI": [r"\bmri\b", r"\bmagnetic resonance\b"],
    "Ultrasound": [r"\bultrasound\b", r"\bus\b"],
}
#: In hybrid mode these take the place of those above.
MODALITIES_HYBRID = {"X-Ray": [r"\bx[- ]?ray(s)?\b"], "CT": [r"\bct[- ]?scan\b"], "MRI": [r"\bmr[- ]?imaging\b"], "Ultrasound": [r"\bsono(graphy|gram)\b"]}
#: What a chest data set needs beside it before another modality is added: (always, in strict mode too).
OTHER_MODALITIES = {
    "CT": (r"\bcomputed tomography\b", r"\bct[- ]?scan\b"),
    "MRI": (r"\bmagnetic resonance\b", r"\bmri\b"),
    "Ultrasound": (r"\bultrasound\b", r"\bsonograph[y|ic]\b|\bpoint[- ]of[- ]care ultrasound\b"),
}
TASKS = {"report-generation": [r"\bradiology report generation\b", r"\breport generation\b", r"\bfree[- ]?text report\b"]}
TASKS_HYBRID = {"report-generation": [r"\breport(s)?\b", r"\bfindings\b", r"\bimpression(s)?\b", r"\bnatural[- ]?language\b"]}
ANCHORS = {
    "vision": [r"\bencoder\b", r"\bbackbone\b", r"\bvision\b", r"\bimage\b", r"\bpatch(es)?\b"],
    "language": [r"\bdecoder\b", r"\blanguage (model|decoder)\b", r"\bgenerator\b", r"\btext\b"],
    "fusion": [r"\battention\b", r"\bfusion\b", r"\balign(ment|ing|ed)\b"],
    "objectives": [r"\bloss\b", r"\bobjective\b", r"\boptimi[sz]e(d|r|ation)\b", r"\btraining\b"],
}

# --- The cleaner's lexicons: (pattern, label), the first that occurs names the token ---------------------

CLEAN_MODELS = (
    (r"\bgpt[-\s]?2\b|distilgpt2|generative pre[-\s]?trained transformer\s*2", "GPT-2"),
    (r"\bgpt[-\s]?3\.5\b", "GPT-3.5"),
    (r"\bgpt[-\s]?3\b", "GPT-3"),
    (r"\bgpt[-\s]?4v?\b|gpt[-\s]?4[-\s]?vision|gpt-4o|gpt4o|gpt-4v", "GPT-4V"),
    (r"\bgpt[-\s]?4\b", "GPT-4"),
    (r"\bllama[-\s]?3\b|\bmeta[-\s]?llama[-\s]?3\b", "LLaMA-3"),
    (r"\bllama[-\s]?2\b|\bmeta[-\s]?llama[-\s]?2\b", "LLaMA-2"),
    (r"\bllama\b|\bmeta[-\s]?llama\b", "LLaMA"),
    (r"\bvicuna\b", "Vicuna"),
    (r"\bmistral\b", "Mistral"),
    (r"\bmixtral\b", "Mixtral"),
    (r"\bmed[-\s]?palm(?:[-\s]?2)?\b", "Med-PaLM"),
    (r"\bpalm[-\s]?2\b|\bpalm\b", "PaLM"),
    (r"\bqwen[-\s]?2[-\s]?vl\b", "Qwen2-VL"),
    (r"\bqwen[-\s]?vl\b", "Qwen-VL"),
    (r"\bqwen\b", "Qwen"),
    (r"\binstruct[-\s]?blip\b", "InstructBLIP"),
    (r"\bblip[-\s]?2\b|blip v?2\b", "BLIP-2"),
    (r"\bblip\b", "BLIP"),
    (r"\balbef\b", "ALBEF"),
    (r"\bflamingo\b", "Flamingo"),
    (r"\bllava[-\s]?med\b", "LLaVA-Med"),
    (r"\bllava\b", "LLaVA"),
    (r"\b(minigpt[-\s]?4)\b", "MiniGPT-4"),
    (r"\botter\b", "Otter"),
    (r"\bx[-\s]?ray[-\s]?gpt\b|xraygpt", "XrayGPT"),
    (r"\bpali[-\s]?x\b", "PaLI-X"),
    (r"\bpali\b", "PaLI"),
    (r"\bkosmos[-\s]?1\b", "Kosmos-1"),
    (r"\bsimvlm\b", "SimVLM"),
    (r"\bofa\b", "OFA"),
    (r"\bb[eE][rR][tT]\b", "BERT"),
    (r"\broberta\b", "RoBERTa"),
    (r"\bt5\b", "T5"),
    (r"\blstm\b", "LSTM"),
    (r"\bgru\b", "GRU"),
    (r"\btransformer\b", "Transformer"),
    (r"\bchexnet\b", "CheXNet"),
    (r"\beggca[-\s]?net\b", "EGGCA-Net"),
    (r"\btrmrg\b", "TrMRG"),
    (r"\bcxr[-\s]?irgen\b", "CXR-IRGen"),
)
CLEAN_VISION = (
    (r"\bvision transformer\b|\bvit\b", "ViT"),
    (r"\bvitb/?16\b|\bvit[-\s]?b/16\b", "ViT"),
    (r"\bvanilla image transformer\b", "ViT"),
    (r"\bswin\b|\bswin[-\s]?transformer\b", "Swin"),
    (r"\bclip\b", "CLIP"),
    (r"\bresnet[-\s]?50\b|resnet 50\b", "ResNet50"),
    (r"\bresnet[-\s]?101\b|resnet 101\b", "ResNet101"),
    (r"\bconvnext\b", "ConvNeXt"),
    (r"\befficientnet\b", "EfficientNet"),
    (r"\bdensenet\b", "DenseNet"),
    (r"\binception\b", "Inception"),
    (r"\bc?nn\b|\bcnn\b", "CNN"),
)
CLEAN_LANGUAGE = (
    (r"\bllama[-\s]?3\b", "LLaMA-3"),
    (r"\bllama[-\s]?2\b", "LLaMA-2"),
    (r"\bllama\b", "LLaMA"),
    (r"\bvicuna\b", "Vicuna"),
    (r"\bgpt[-\s]?2\b|distilgpt2", "GPT-2"),
    (r"\bgpt[-\s]?3\.5\b", "GPT-3.5"),
    (r"\bgpt[-\s]?3\b", "GPT-3"),
    (r"\bgpt[-\s]?4v?\b|gpt[-\s]?4o\b", "GPT-4V"),
    (r"\bt5\b", "T5"),
    (r"\bb[eE][rR][tT]\b", "BERT"),
    (r"\broberta\b", "RoBERTa"),
    (r"\btransformer\b", "Transformer"),
    (r"\blstm\b", "LSTM"),
    (r"\bgru\b", "GRU"),
)
CLEAN_FUSION = (
    (r"\bcross[-\s]?attention\b", "cross-attention"),
    (r"\bco[-\s]?attention\b", "co-attention"),
    (r"\bself[-\s]?attention\b", "self-attention"),
    (r"\bcondition(ed|ing)?\b", "conditioned"),
    (r"\bconcat(enation)?\b", "concatenation"),
    (r"\blate[-\s]?fusion\b", "late fusion"),
    (r"\bearly[-\s]?fusion\b", "early fusion"),
    (r"\bgated\b|\bgating\b", "gated"),
    (r"\bfilm\b", "FiLM"),
)
CLEAN_OBJECTIVES = (
    (r"\bitm\b|image[-\s]?text matching", "ITM"),
    (r"\bitc\b|image[-\s]?text contrast(ive)?\b|contrastive", "contrastive"),
    (r"\bmlm\b|masked language model(ing)?\b", "MLM"),
    (r"\bmim\b|masked image model(ing)?\b", "MIM"),
    (r"\bmrm\b|masked region model(ing)?\b", "MRM"),
    (r"\bcaption(ing)?\b", "captioning"),
    (r"\bcoverage\b", "coverage"),
    (r"\bcross[-\s]?entropy\b", "cross-entropy"),
    (r"\bnext sentence prediction\b|\bnsp\b", "NSP"),
    (r"\breinforcement learning\b|\brl\b", "RL"),
)
CLEAN_FAMILIES = (
    (r"\balbef\b", "ALBEF"),
    (r"\bblip[-\s]?2\b|blip v?2\b", "BLIP-2"),
    (r"\bblip\b", "BLIP"),
    (r"\bflamingo\b", "Flamingo"),
    (r"\bllava[-\s]?med\b", "LLaVA-Med"),
    (r"\bllava\b", "LLaVA"),
    (r"\bminigpt[-\s]?4\b", "MiniGPT-4"),
    (r"\binstruct[-\s]?blip\b", "InstructBLIP"),
    (r"\botter\b", "Otter"),
    (r"\bx[-\s]?ray[-\s]?gpt\b|xraygpt", "XrayGPT"),
    (r"\bpali[-\s]?x\b", "PaLI-X"),
    (r"\bpali\b", "PaLI"),
    (r"\bkosmos[-\s]?1\b", "Kosmos-1"),
    (r"\bsimvlm\b", "SimVLM"),
    (r"\bofa\b", "OFA"),
    (r"\bclip\b", "CLIP"),
)
CLEAN_RAG = (
    r"\brag\b", r"\bretrieval[-\s]?augmented( generation)?\b", r"\bretrieve[-\s]?augmented( generation)?\b",
    r"\bdoc(ument)?[-\s]?retrieval\b", r"\bdense[-\s]?retrieval\b", r"\bretriever\b",
)

#: Cues of retrieval in a record's other cells.
RAG_STRONG_CUES = (
    r"\bretrieval[- ]?augmented(?: generation)?\b",
    r"\bretrieve[- ]?augmented(?: generation)?\b",
    r"\brag\b",
    r"\bretriever(s)?\b",
    r"\bevidence[- ]?retrieval\b",
    r"\bknowledge[- ]?(base|bank|retrieval)\b",
    r"\bmemory\b.*\b(index|retrieve|retrieval)\b",
    r"\bnearest[- ]?neighbor(s)?\b",
    r"\bk[- ]?nn\b",
    r"\btemplate[- ]?retrieval\b",
    r"\breport[- ]?retrieval\b",
    r"\bcase[- ]?retrieval\b",
    r"\brerank(er)?\b|\bre[- ]?rank(er)?\b",
    r"\bbm25\b",
    r"\bfaiss\b",
    r"\bvector[- ]?(db|store|index)\b",
    r"\bdense[- ]?retrieval\b",
    r"\bdoc(ument)?[- ]?retrieval\b",
    r"\bretrieve[- ]?then[- ]?read\b",
)
#: Denials of retrieval, in any cell.
RAG_NEG_CUES = (r"\bno\b.*\bretriev", r"\bwithout\b.*\bretriev", r"\bnon[- ]?retrieval\b")
#: Columns that may tell of retrieval, of those a record has.
RAG_TELLING = ("file", "title", "abstract", "model", "family", "objectives", "fusion", "task", "notes", "method", "approach", "system", "language", "vision")
#: Parts of a model's or family's name that make a record a VLM's.
VLM_FAMILY_KEYS = ("albef", "blip-2", "blip", "flamingo", "llava-med", "llava", "minigpt-4", "instructblip", "otter", "xraygpt", "pali-x", "pali", "kosmos-1", "simvlm", "ofa")
#: What a model's name alone doesn't tell, which family goes first, and the objectives of families, the first that occurs.
GENERIC_MODELS = ("transformer", "cnn", "rnn", "cnn-rnn", "bert", "roberta", "t5", "lstm", "gru")
PRIMARY_FAMILIES = ("LLaVA", "BLIP-2", "BLIP", "ALBEF", "Flamingo", "MiniGPT-4", "InstructBLIP", "Otter", "XrayGPT", "PaLI-X", "PaLI", "Kosmos-1", "SimVLM", "OFA", "CLIP")
FAMILY_OBJECTIVES = (
    ("albef", "contrastive, ITM"), ("blip-2", "contrastive, ITM"), ("blip", "contrastive, ITM"), ("flamingo", "ITM"), ("llava", "contrastive"), ("llava-med", "contrastive"), ("minigpt-4", "contrastive"),
    ("otter", "contrastive"), ("xraygpt", "contrastive"), ("cxr-irgen", "contrastive, ITM"), ("token-mixer", "contrastive, ITM"), ("pairaug", "contrastive, ITM"), ("instructblip", "contrastive, ITM"),
    ("pali-x", "contrastive, ITM"), ("pali", "contrastive, ITM"), ("simvlm", "ITM"), ("ofa", "ITM"),
)

# --- Exact spellings (lower case) and their labels --------------------------------------------------------

DATASET_NAMES = {
    "chestx-ray14": "NIH ChestX-ray14", "chestxray14": "NIH ChestX-ray14", "chexpert": "CheXpert", "padchest": "PadChest", "rsna": "RSNA Pneumonia",
    "rsna pneumonia": "RSNA Pneumonia", "reflacx": "REFLACX", "cxr-repair": "CXR-RePaiR", "cxr repair": "CXR-RePaiR",
}
METRIC_NAMES = {
    "bleu": "BLEU", "bleu4": "BLEU", "cider": "CIDEr", "meteor": "METEOR", "rouge": "ROUGE", "rouge-l": "ROUGE", "radgraph": "RadGraph",
    "chexbert": "CheXbert", "radcliq": "RadCliQ", "gleu": "GLEU", "accuracy": "Accuracy", "f1": "F1",
}
MODEL_NAMES = {
    "llama": "LLaMA", "llama-2": "LLaMA", "gpt2": "GPT-2", "gpt-2": "GPT-2", "gpt 2": "GPT-2", "gpt4v": "GPT-4V", "gpt-4v": "GPT-4V",
    "vit": "ViT", "clip": "CLIP", "resnet50": "ResNet50", "resnet-50": "ResNet50",
}
MODALITY_NAMES = {
    "x-ray": "X-Ray", "xray": "X-Ray", "x ray": "X-Ray", "ct": "CT", "mri": "MRI", "ultrasound": "Ultrasound", "mixed": "Mixed", "radiology": "X-Ray", "not reported": "Not reported",
}

# --- Single values: the first part that occurs in a token names it ----------------------------------------

SINGLE_VISION = (
    ("vit-b/16", "ViT-B/16"), ("vision transformer", "ViT"), ("vit", "ViT"), ("resnet-50", "ResNet-50"), ("resnet", "ResNet"), ("clip", "CLIP"), ("dino", "DINO"), ("cnn", "CNN"), ("u-net", "U-Net"),
)
SINGLE_LANGUAGE = (
    ("llama", "LLaMA"), ("bert-base", "BERT-base"), ("bertbase", "BERT-base"), ("bert", "BERT"), ("gpt-2", "GPT-2"), ("t5", "T5"), ("lstm", "LSTM"), ("transformer", "Transformer"),
)
SINGLE_FUSION = (
    ("cross-attention", "Cross-Attention"), ("co-attention", "Co-Attention"), ("multimodal encoder", "Multimodal Encoder"), ("early fusion", "Early Fusion"),
    ("late fusion", "Late Fusion"), ("concatenation", "Concatenation"), ("gated fusion", "Gated Fusion"), ("attention fusion", "Attention Fusion"),
)
SINGLE_MODELS = ("ALBEF", "BLIP", "BLIP-2", "CXR-IRGen", "R2Gen", "PPKED", "M2Trans", "TieNet", "EGGCA-Net", "RoentGen", "TrMRG")
SINGLE_MODALITY = ((r"\bx[- ]?ray\b|\bcxr\b", "X-Ray"), (r"\bmri\b", "MRI"), (r"\bct\b", "CT"), (r"\bultrasound\b", "Ultrasound"))

# --- Titles, authors and names in a paper's text -----------------------------------------------------------

NOT_TITLE = (
    "open access", "digital object identifier", "doi", "arxiv", "springer", "elsevier", "proceedings", "journal", "transactions", "conference", "computer vision foundation",
    "wacv", "cvpr", "iccv", "eccv", "isbi", "ieee", "acm", "kdd", "neurips", "iclr", "received", "accepted", "published", "copyright", "corresponding author", "corresponding authors",
    "university", "department", "school", "college", "institute", "hospital", "laboratory", "centre", "center", "faculty", "research group",
)
NOT_NAME_START = ("Report", "Computer", "Vision", "Smart", "Systems")
NAME = r"\b[A-Z][a-z]+(?:[-' ][A-Z][a-z]+){1,2}\b"
NEAR_MODELS = ("ALBEF", "BLIP", "CXR-IRGen", "R2Gen", "KERP", "PPKED", "HRGR", "M2KT", "RoentGen", "LDM", "CoAtt", "CMN", "PMA", "EALBEF", "EGGCA-Net", "EGGCA", "KERP++")
NOT_MODEL = ("MRI", "CT", "CXR", "CNN", "LSTM", "BERT", "VIT", "T5", "GPT", "IEEE", "LLM", "BEF")
PROPOSES = r"(propose|present|introduce|develop|call(?:ed)?)\b.{0,240}"
BACKFILL_OBJECTIVES = (
    (r"\b(itm|image[- ]text matching)\b", "ITM"), (r"\bmlm|masked[- ]language[- ]model(ing)?\b", "MLM"), (r"\bnsp|next sentence prediction\b", "NSP"), (r"\bcontrastive\b", "contrastive"),
    (r"\bcross[- ]entropy\b", "cross-entropy"), (r"\breinforcement learning\b", "RL"), (r"\badversarial\b", "adversarial"), (r"\bcoverage\b", "coverage"),
)
BACKFILL_CLASSES = (
    (r"\bradiology report generation\b", "Radiology Report Generation"), (r"\breport generation\b", "Report Generation"), (r"\bimage[- ]text matching\b", "Image-Text Matching"),
    (r"\bimage[- ]to[- ]sequence\b", "Image-to-Sequence"), (r"\bimage[- ]report\b", "Image-Report"),
)
METRIC_WORDS = ("bleu", "rouge", "meteor", "cider", "radgraph", "bertscore", "accuracy", "f1", "gleu", "fid", "auroc", "radcliq", "chexbert")
LOSS_SENTENCE = r"\b(?:loss|objective|optimiz(?:e|ation)|train(?:ed|ing))\b.*?(?:(?:\w+[- ]?){1,5})"

# --- What a value needs in its context, by value ------------------------------------------------------------

EVIDENCE = {
    "ViT": r"\bViT\b|Vision Transformer", "CLIP": r"\bCLIP\b", "DeiT": r"\bDeiT\b", "Swin": r"\bSwin\b", "ResNet50": r"\bResNet(?:-?50)?\b", "CNN": r"\bCNN\b|convolutional neural network",
    "LLaMA": r"\bLLaMA\b", "BERT": r"\bBERT\b", "GPT-2": r"\bGPT-?2\b", "T5": r"\bT5\b", "LSTM": r"\bLSTM\b", "GRU": r"\bGRU\b", "Transformer": r"\bTransformer\b",
    "cross-attention": r"\bcross[- ]?attention\b", "co-attention": r"\bco[- ]?attention\b", "concatenation": r"\bconcatenation|\bconcat\b", "two-stream": r"\b(two[- ]?stream|dual[- ]?encoder)\b",
    "single-stream": r"\bsingle[- ]?stream\b", "report-generation": r"\breport[- ]?generation\b", "image-text matching": r"\bimage[- ]?text matching\b", "image-report generation": r"\bimage[- ]?report\b",
    "RAG": r"\b(RAG|retrieval[- ]?augmented|retrieval[- ]?based|retrieve[-\s\w]*context|retriever|retrieval module|index|FAISS|BM25|nearest[- ]neighbor|vector store|Chroma)\b",
}

# --- Words of a class cell that name a task, and cues of a field in a text -----------------------------------

TASK_TERMS = (
    r"report generation", r"radiology report generation", r"image[-\s]?text matching", r"image[-\s]?report", r"image[-\s]?to[-\s]?sequence", r"classification", r"segmentation",
    r"retrieval", r"caption", r"captioning", r"vqa", r"question[-\s]?answer(ing)?", r"detection",
)
MASK_CUES = {
    "Datasets (train)": r"(mimic[- ]?cxr|chexpert|open[- ]?i|padchest|nih chestx[- ]?ray(?:14)?|cxr[- ]?repair)",
    "Datasets (eval)": r"(mimic[- ]?cxr|chexpert|open[- ]?i|padchest|nih chestx[- ]?ray(?:14)?|cxr[- ]?repair)",
    "Vision Enc": r"\b(vit|swin|resnet|clip|cnn)\b",
    "Lang Dec": r"\b(bert|gpt[- ]?2|llama|t5|vicuna|transformer)\b",
    "Fusion": r"(cross[- ]?attention|co[- ]?attention|early fusion|late fusion|gated|conditional|conditioned)",
    "Paired": r"\bpaired\b|\bpaired image[- ]?text\b|\baligned report\b|\bradiology report pairs?\b",
    "RAG": r"(retrieval[- ]?augmented|rag\b|retrieve|bm25|faiss|chroma)",
    "Family": r"(albef|blip[- ]?2|flamingo|llava|minigpt[- ]?4|otter|xraygpt|trmrg|cxr[- ]?irgen)",
    "Metrics(primary)": r"(bleu|rouge|cid(er)?|meteor|f1\b|accuracy|radgraph|chexbert|bertScore|spice|radcliq|gleu)",
    "Modality": r"(x[- ]?ray|cxr|rad(iology)?|imaging|ct|mri|ultrasound|fundus|patholog(y|ical))",
    "Model": r"(albef|blip[- ]?2|flamingo|llava|minigpt[- ]?4|chexnet|chexpert|trmrg|cxr[- ]?irgen|gpt[- ]?4v?)",
    "Class": r"\b(classification|caption|retrieval|segmentation|localization|vqa|report[- ]?generation)\b",
    "Task": r"\b(vqa|report[- ]?generation|retrieval|caption|classification|segmentation|localization)\b",
    "Objectives": r"(itm|itc|contrastive|cross[- ]?entropy|rl|reinforcement|coverage)",
    "VLM?": r"\b(vlm|vision[- ]?language model|multimodal (model|transformer))\b",
}
