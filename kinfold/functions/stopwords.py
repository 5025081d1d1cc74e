"""Default stop words: Spark's English list and common Indonesian words."""

from __future__ import annotations

import zipfile
from functools import lru_cache
from pathlib import Path

import pyspark

# Frequent Indonesian function words.
INDONESIAN = (
    "ada adalah agar akan aku anda antara apa apabila apakah atas atau bagi bagaimana bagian "
    "bahkan bahwa banyak beberapa begitu belum bila bisa boleh bukan cara cukup dalam dan dapat "
    "dari daripada dengan demi demikian di dia dimana dulu guna hal hampir hanya harus hingga ia "
    "ialah ini itu jadi jangan jika juga kalau kali kami kamu karena kata ke kembali kemudian "
    "kepada ketika kita kurang lagi lah lain lalu lebih maka masih mau melalui memang "
    "menjadi mereka meski mungkin namun nanti nya oleh orang pada para paling pasti per perlu "
    "pernah pun saat saja saling sama sambil sampai sangat saya seorang sebab sebagai sebelum "
    "sebuah secara sedang segera sehingga sejak selain selalu selama seluruh semua sering serta "
    "sesuatu setelah setiap siapa sudah supaya tanpa tapi telah tentang terhadap tersebut tetapi "
    "tiap tidak untuk walau yaitu yang"
).split()


@lru_cache(1)
def english_stop_words() -> tuple[str, ...]:
    """Spark's English list, read from the library's own resource, so no session is needed."""
    for jar in sorted(Path(pyspark.__file__).parent.glob("jars/spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as archive:
            return tuple(archive.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split())
    from pyspark.ml.feature import StopWordsRemover  # a client without jars asks the session

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def default_stop_words() -> list[str]:
    """Union of the English and Indonesian lists."""
    return sorted(set(english_stop_words()) | set(INDONESIAN))
