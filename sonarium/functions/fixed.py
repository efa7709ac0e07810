"""Word lists, names, lifetimes and explanations that results depend on."""

# fixed values: stop words of the cohort term count
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him",
    "her", "us", "them",
]

# fixed values: characters stripped from both ends of a token
TOKEN_STRIP = '.,!?";:()[]{}'

# fixed values: ASCII punctuation removed before transcripts are compared
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# fixed values: media type per audio file extension
MEDIA_TYPES = {".wav": "audio/wav", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".flac": "audio/flac"}

# fixed values: other names of a dataset
DATASET_ALIASES = {"cv-valid-dev": "common-voice"}
GLOBAL_DATASETS = ("common-voice", "cv-valid-dev", "ravdess")

# fixed values: ground-truth columns per dataset, first existing one wins
TRUTH_COLUMNS = {
    "common-voice": ("text", "transcript", "sentence", "label"),
    "ravdess": ("statement", "text", "transcript", "sentence"),
}
LABEL_TRUTH_COLUMNS = ("emotion", "label", "category")
TRUTH_PREFIX = "cv-valid-dev/"

# fixed values: label per file-name mark, tried in this order
NAME_LABELS = (
    ("neutral", ("01-01", "neutral")),
    ("happy", ("01-03", "happy", "joy")),
    ("sad", ("01-04", "sad", "sadness")),
    ("angry", ("01-05", "angry", "anger")),
    ("fear", ("01-06", "fear", "afraid")),
    ("disgust", ("01-07", "disgust")),
    ("surprise", ("01-08", "surprise")),
    ("calm", ("01-02", "calm")),
)

# fixed values: lifetime of a cached result in seconds
SHORT_TTL = 6 * 60 * 60
LONG_TTL = 24 * 60 * 60
TTL_BY_KIND = {
    "prediction": SHORT_TTL,
    "saliency": SHORT_TTL,
    "attention": SHORT_TTL,
    "embedding": LONG_TTL,
    "features": LONG_TTL,
    "attention_pairs": LONG_TTL,
}
SESSION_TTL = 24 * 60 * 60

# fixed values: JSON fields that may hold a prediction, first filled one wins
PREDICTION_FIELDS = ("predicted_transcript", "predicted_emotion", "prediction", "text")

# fixed values: explanation per feature name
FEATURE_TEXTS = {
    "spectral_rolloff": "The frequency below which 85% of spectral energy is contained. Indicates brightness vs darkness of audio.",
    "spectral_centroid": "The center of mass of the spectrum. Higher values indicate brighter sounds with more high-frequency content.",
    "spectral_bandwidth": "The width of the spectrum. Measures how spread out the frequency content is.",
    "spectral_contrast": "The difference in amplitude between peaks and valleys in the spectrum. Indicates audio clarity.",
    "spectral_flatness": "Measures how noise-like vs tone-like the spectrum is. Values near 0 = tonal, near 1 = noise-like.",
    "zero_crossing_rate": "Rate at which the audio signal changes from positive to negative. Higher for noisy/unvoiced sounds.",
    "tempo": "The perceived speed of the music in beats per minute (BPM). Estimated from onset detection.",
    "duration": "Length of the audio file in seconds.",
    "rms": "Root Mean Square energy. Measures the overall loudness/power of the audio signal.",
    "mfcc_1": "First Mel-frequency cepstral coefficient. Represents overall spectral shape and timbre.",
    "mfcc_2": "Second MFCC. Captures the balance between low and high frequencies.",
    "mfcc_3": "Third MFCC. Related to the slope of the spectral envelope.",
    "mfcc_4": "Fourth MFCC. Captures finer spectral details and formant information.",
    "mfcc_5": "Fifth MFCC. Represents additional spectral shape characteristics.",
    "mfcc_6": "Sixth MFCC. Captures mid-frequency spectral features.",
    "mfcc_7": "Seventh MFCC. Related to spectral fine structure.",
    "mfcc_8": "Eighth MFCC. Represents higher-order spectral relationships.",
    "mfcc_9": "Ninth MFCC. Captures additional timbral characteristics.",
    "mfcc_10": "Tenth MFCC. Represents complex spectral interactions.",
    "mfcc_11": "Eleventh MFCC. Captures additional spectral characteristics.",
    "mfcc_12": "Twelfth MFCC. Represents fine-grain spectral features.",
    "mfcc_13": "Thirteenth MFCC. Final coefficient capturing subtle spectral details.",
    "chroma_1": "First chroma feature. Represents the energy in the C pitch class.",
    "chroma_2": "Second chroma feature. Represents the energy in the C#/Db pitch class.",
    "chroma_3": "Third chroma feature. Represents the energy in the D pitch class.",
    "chroma_4": "Fourth chroma feature. Represents the energy in the D#/Eb pitch class.",
    "chroma_5": "Fifth chroma feature. Represents the energy in the E pitch class.",
    "chroma_6": "Sixth chroma feature. Represents the energy in the F pitch class.",
    "chroma_7": "Seventh chroma feature. Represents the energy in the F#/Gb pitch class.",
    "chroma_8": "Eighth chroma feature. Represents the energy in the G pitch class.",
    "chroma_9": "Ninth chroma feature. Represents the energy in the G#/Ab pitch class.",
    "chroma_10": "Tenth chroma feature. Represents the energy in the A pitch class.",
    "chroma_11": "Eleventh chroma feature. Represents the energy in the A#/Bb pitch class.",
    "chroma_12": "Twelfth chroma feature. Represents the energy in the B pitch class.",
    "tonnetz_1": "First tonal centroid. Represents the position in tonal space along the circle of fifths.",
    "tonnetz_2": "Second tonal centroid. Captures major vs minor tonality.",
    "tonnetz_3": "Third tonal centroid. Represents the diminished chord dimension.",
    "tonnetz_4": "Fourth tonal centroid. Additional harmonic relationship dimension.",
    "tonnetz_5": "Fifth tonal centroid. Complex harmonic space representation.",
    "tonnetz_6": "Sixth tonal centroid. Final tonal space dimension.",
    "rolloff": "Alias for spectral_rolloff. The frequency below which 85% of spectral energy is contained.",
    "centroid": "Alias for spectral_centroid. The center of mass of the spectrum.",
    "bandwidth": "Alias for spectral_bandwidth. The width of the spectrum.",
    "contrast": "Alias for spectral_contrast. The difference between spectral peaks and valleys.",
    "flatness": "Alias for spectral_flatness. Measures how noise-like vs tone-like the audio is.",
    "zcr": "Alias for zero_crossing_rate. Rate of signal sign changes.",
    "energy": "Total energy of the audio signal. Measures overall signal power.",
    "loudness": "Perceptual loudness measurement. Related to RMS but perceptually weighted.",
    "brightness": "Perceptual brightness. Related to spectral centroid but perceptually calibrated.",
    "roughness": "Perceptual roughness. Measures how harsh or smooth the audio sounds.",
    "sharpness": "Perceptual sharpness. Measures the presence of high-frequency content.",
    "pitch": "Fundamental frequency of the audio signal. The perceived pitch.",
    "harmonicity": "Measure of how harmonic the audio signal is. Values near 1 indicate strong harmonics.",
    "noisiness": "Measure of how noisy the audio signal is. Inverse of harmonicity.",
    "onset_rate": "Rate of detected onsets in the audio. Measures rhythmic density.",
    "beat_strength": "Strength of detected beat patterns. Measures rhythmic clarity.",
}

# fixed values: explanation per part of a feature name, tried in this order after the exact names
FEATURE_CLASS_TEXTS = (
    ("mfcc", "Mel-frequency cepstral coefficient. Represents spectral shape and timbral characteristics of the audio."),
    ("chroma", "Chroma feature. Represents the energy distribution across the 12 pitch classes (musical notes)."),
    ("tonnetz", "Tonal centroid feature. Represents the position in harmonic/tonal space."),
    ("spectral", "Spectral feature. Describes frequency domain characteristics of the audio signal."),
    ("temporal", "Temporal feature. Describes time domain characteristics of the audio signal."),
)
FEATURE_DEFAULT_TEXT = "Audio feature - extracting characteristics from the audio signal for analysis."
FEATURE_EMPTY_TEXT = "Unknown audio feature."

# fixed values: ordinal words used inside the explanations
ORDINALS = [
    "First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh",
    "Twelfth", "Thirteenth", "Fourteenth", "Fifteenth", "Sixteenth", "Seventeenth", "Eighteenth", "Nineteenth",
    "Twentieth",
]
