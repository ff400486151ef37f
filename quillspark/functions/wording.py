"""Texts of replies. Places in braces are filled by columns."""

from .text import DISCLAIMER

# Reply texts, in natural order.
END = "\n\n" + DISCLAIMER
PREPARATION_DETAIL = (
    "Detail cara pengolahan {name}:\nBahan yang dipakai: {items}.\n\nLangkah pengolahan:\n{steps}\n\nDosis/kisaran penggunaan: {dose}\nCatatan kewaspadaan: {care}\n\n"
    "Gunakan bahan bersih, alat bersih, dan jangan menyimpan ramuan terlalu lama. Hentikan penggunaan bila muncul gatal, sesak, nyeri perut, mual berat, ruam memburuk, atau keluhan tidak cocok."
) + END
NO_ITEMS = "bahan sesuai kartu rekomendasi"
NO_STEPS = "Ikuti cara pengolahan pada kartu rekomendasi."
NO_CARD = "Saya belum menemukan kartu rekomendasi terakhir untuk dijelaskan lebih detail. Silakan mulai sesi baru atau ulangi keluhan utama agar saya bisa menyusun rekomendasi ulang."
FEEDBACK_NAME = "rekomendasi tadi"
FEEDBACK = {
    "helpful": (
        "Terima kasih, saya catat bahwa rekomendasi {name} membantu. Masukan ini akan disimpan sebagai data evaluasi kualitas model dan knowledge base.\n\n"
        "Tetap pantau gejala. Bila keluhan memburuk, muncul demam tinggi, sesak, nyeri berat, perdarahan, dehidrasi, atau reaksi alergi, prioritaskan pemeriksaan tenaga kesehatan."
    ),
    "not_helpful": (
        "Terima kasih, saya catat bahwa rekomendasi {name} belum membantu atau kurang cocok. Masukan ini penting untuk evaluasi model dan kurasi knowledge base berikutnya.\n\n"
        "Boleh jelaskan singkat bagian yang kurang cocok: gejala tidak membaik, cara pengolahan kurang jelas, bahan sulit didapat, atau muncul efek tidak nyaman? Jika ada tanda bahaya, sebaiknya segera periksa."
    ),
    "unclear_preparation": (
        "Terima kasih, saya catat bahwa bagian cara pengolahan masih kurang jelas. Saya akan gunakan masukan ini untuk memperbaiki data training dan format jawaban berikutnya.\n\n"
        "Kamu juga bisa klik atau ketik: Jelaskan cara pengolahan ramuan ini lebih detail."
    ),
    "": "Terima kasih, masukan kamu sudah saya simpan sebagai data evaluasi. Jika ingin, beri tahu bagian mana yang perlu diperbaiki: hasil, rasa, bahan, dosis, atau cara pengolahan.",
}
RECOMMENDATION = (
    "Ringkasan anamnesis:\n{summary}\n\nBerdasarkan knowledge base dan konteks retrieval, keluhan masih saya posisikan sebagai '{complaint}' selama tidak ada tanda bahaya. Rekomendasi awal ramuan herbal yang relevan:\n\n"
    "Ramuan: {name}\nBahan: {items}\nCara pengolahan: {preparation}\nDosis/kisaran penggunaan: {dose}\nCatatan kewaspadaan: {care}\nSumber ringkas: {source}\n\nKonteks RAG yang dipakai:\n{contexts}"
) + END
FOLLOW_UP = (
    "Baik, saya tangkap dulu ya. {patient}\n\nSebelum saya menyarankan langkah awal atau ramuan pendamping, saya perlu bertanya seperti dokter saat anamnesis: satu hal yang paling menentukan keamanan dulu.\n\n{question}\n\n"
    "Jawab singkat saja sesuai yang kamu rasakan. Kalau tidak ada, cukup tulis 'tidak ada'.\n\nKenapa saya tanya ini: {why} {flags}\n\nTahap anamnesis: {number}/{most}. "
) + DISCLAIMER
FOLLOW_UP_WHY = "Pertanyaan ini dipilih untuk memperjelas dugaan kondisi dan menyingkirkan tanda bahaya."
FOLLOW_UP_ASK = "Bisa ceritakan gejala yang paling mengganggu saat ini?"
FOLLOW_UP_FLAGS = "Tanda yang tetap perlu diwaspadai: {flags}."
FOLLOW_UP_NO_FLAGS = "Jika ada demam tinggi, sesak, nyeri hebat, perdarahan, dehidrasi, atau kondisi memburuk, segera periksa ke tenaga kesehatan."
FOLLOW_UP_SUSPECTED = "beberapa dugaan kondisi ringan"
REPLACED_WHY = "Pertanyaan diganti agar tidak mengulang informasi yang sudah disebut user dan tetap menyingkirkan tanda bahaya."
CASE_FOLLOW_UP = (
    "Baik, saya tangkap keluhan kamu sementara mengarah ke '{complaint}'. Sebelum membahas ramuan, saya perlu memastikan satu hal seperti dokter saat anamnesis agar sarannya tidak terburu-buru.\n\n{questions}{source}\n\n"
    "Jawab singkat saja sesuai yang kamu rasakan. Kalau tidak ada, cukup tulis 'tidak ada'.\n\nKalau ada tanda berat seperti demam tinggi, sesak, darah, dehidrasi, nyeri hebat, atau keluhan pada bayi/kehamilan, sebaiknya prioritaskan pemeriksaan medis."
) + END
CASE_SOURCE = "\n\nPertanyaan ini memakai rujukan anamnesis: {source}."
LAST_CLARIFICATION = "Saya masih perlu satu klarifikasi lagi sebelum menyusun jawaban akhir. Bisa jelaskan sejak kapan keluhan ini muncul, apakah memburuk, dan apakah ada demam atau sesak?" + END
LAST_CLARIFICATION_ASK = "Sejak kapan keluhan ini muncul, apakah memburuk, dan apakah ada demam atau sesak?"
ASSESSED = {
    "summary": "Ringkasan anamnesis:\n{summary}",
    "suspected": "Dugaan kondisi yang paling mungkin saat ini: {suspected}.",
    "reasoning": "Pertimbangan utama: {reasoning}",
    "final": "{final}",
    "recommendation": "Rekomendasi ramuan herbal awal:\nRamuan: {name}\nBahan: {items}\nCara pengolahan: {preparation}\nDosis/kisaran penggunaan: {dose}\nCatatan kewaspadaan: {care}\nSumber ringkas: {source}",
    "contexts": "Konteks RAG yang dipakai:\n{contexts}",
    "warning": "Catatan keselamatan: {warning}" + END,
}
ASSESSED_SUSPECTED = "dugaan kondisi berbasis anamnesis"
ASSESSED_REASONING = "Dugaan kondisi disusun dari gejala yang muncul selama percakapan dan konteks retrieval."
ASSESSED_WARNING = "Segera periksa ke tenaga kesehatan bila keluhan memburuk atau muncul tanda bahaya."
ASSESSED_FINAL = "Untuk saat ini keluhan lebih mengarah ke {suspected}, tetapi tetap ini belum bisa dianggap sebagai diagnosis medis final."
ASSESSED_NO_RECOMMENDATION = "Saya belum menemukan ramuan herbal yang cukup aman dan cukup ter-ground ke knowledge base untuk langsung direkomendasikan pada kondisi ini."
RED_FLAG = "Saya mendeteksi tanda yang perlu diwaspadai: {flags}. Untuk kondisi seperti ini, saya tidak akan menyarankan ramuan herbal sebagai penanganan utama. Sebaiknya segera konsultasi ke tenaga kesehatan atau fasilitas kesehatan terdekat, terutama bila gejala berat, menetap, atau memburuk." + END
REFERRAL = (
    "Baik, dari cerita kamu sejauh ini, keluhan lebih aman diposisikan sebagai {suspected}.\n\nAlasannya: {reason}\n\nYang sebaiknya kamu lakukan sekarang: {warning}\n\n"
    "Saya belum akan memaksakan ramuan herbal sebagai solusi utama, karena pada demam atau keluhan yang masih mungkin infeksi, yang paling penting adalah memastikan tidak ada tanda bahaya dan memantau perkembangan gejala."
) + END
REFERRAL_DEFAULT_REASON = "Kasus ini tidak aman untuk jalur herbal mandiri."
REFERRAL_DEFAULT_WARNING = "Prioritaskan pemeriksaan tenaga kesehatan."
REFERRAL_WARNING = "Prioritaskan pemeriksaan tenaga kesehatan dan jangan menunda bila keluhan memburuk."
REFERRAL_MODEL_WORDS = ("scope model", "internal_medicine", "safety layer")
REFERRAL_REWRITES = {"scope model: internal_medicine": "perlu evaluasi medis", "scope model: critical": "ada tanda yang perlu perhatian segera"}
REFERRAL_REASON = "gejala seperti {symptoms} perlu dilihat polanya dulu. Jika menetap, memburuk, atau muncul tanda bahaya, pemeriksaan langsung lebih aman daripada hanya mengandalkan ramuan."
REFERRAL_SYMPTOMS = "keluhan yang kamu sebutkan"
SUSPECTED_MODEL = "keluhan yang perlu pemeriksaan langsung"
SUSPECTED_FEVER = "demam atau infeksi yang masih perlu dipantau dan belum bisa dipastikan jenisnya"
SUSPECTED_UNKNOWN = "keluhan yang belum bisa dipastikan aman hanya dengan perawatan mandiri"
WATCH = "Pantau suhu dan perkembangan keluhan. Periksa ke tenaga kesehatan bila demam bertahan lebih dari 3 hari, suhu makin tinggi, keluhan memburuk, atau muncul tanda bahaya."
WATCH_WORDS = ("herbal tidak diposisikan", "tanda bahaya")
OUT_OF_SCOPE = "Saya belum menemukan keluhan ringan yang sesuai dengan knowledge base ramuan herbal saat ini. Coba jelaskan keluhan utama dengan singkat, misalnya mual ringan, tenggorokan tidak nyaman, nafsu makan menurun, pegal ringan, diare ringan tanpa darah, atau badan kurang fit." + END
GUIDANCE = {
    "summary": "Ringkasan anamnesis:\n{summary}",
    "title": "Keluhan kamu belum saya posisikan sebagai keluhan ringan yang aman ditangani dengan ramuan herbal saja. Dari knowledge base, ada konteks yang mengarah ke '{title}'.",
    "symptoms": "Gejala kunci yang sering terkait: {symptoms}.",
    "overview": "Ringkasan singkat: {overview}",
    "questions": "Hal yang perlu dipastikan lebih lanjut:\n{questions}",
    "warnings": "Tanda bahaya atau alasan untuk segera diperiksa:\n{warnings}",
    "diagnosis": "Pemeriksaan/penanganan medis yang lazim: {diagnosis}",
    "prevention": "Edukasi pencegahan yang relevan:\n{prevention}",
    "care": "Arahan awal: {care}\n\nBila keluhan mengarah ke infeksi tropis, penyakit menular kronis, atau infeksi jamur yang luas/berulang, prioritas utamanya adalah pemeriksaan medis. Herbal bila ada hanya boleh diposisikan sebagai pendamping edukatif, bukan pengganti terapi utama.",
    "end": DISCLAIMER,
}
GUIDANCE_TITLE = "kondisi yang perlu evaluasi medis"
GUIDANCE_CARE = "Untuk keamanan, sebaiknya periksa ke tenaga kesehatan dan jangan menjadikan herbal sebagai terapi utama."
SUMMARY = "- Keluhan: {complaint}\n- Gejala terdeteksi: {present}\n- Gejala yang sudah disangkal: {absent}\n- Durasi: {duration}\n- Detail intensitas/perburukan: {detail}\n- Safety check: {safety}"
NO_SUMMARY = "- Keluhan ringan terdeteksi dari percakapan."
SUMMARY_DURATION = ("ada", "belum jelas")
SUMMARY_DETAIL = ("sudah ada", "belum jelas")
SUMMARY_SAFETY = ("ada klarifikasi tanda bahaya", "belum ada klarifikasi tanda bahaya eksplisit")
PATIENT = {"symptoms": "Keluhan yang sudah saya catat: {symptoms}.", "duration": "Durasi: {duration}.", "absent": "Gejala yang sudah kamu sangkal: {absent}."}
PATIENT_DURATION = "durasi sudah disebut"
PATIENT_SAFETY = ("Sebagian tanda bahaya sudah kamu jawab tidak ada.", "Tanda bahaya belum lengkap tersaring.")
NO_CONTEXTS = "- Tidak ada konteks tambahan."
CLARIFY = (
    "Maaf, pertanyaan saya tadi kurang sederhana. Saya jelaskan ulang ya.\n\nYang saya maksud: {explained}\n\nPertanyaan sederhananya: {question}\n\n"
    "Jawab pendek saja. Kalau tidak ada gejala berat, tulis: tidak ada. Kalau ada salah satu, sebutkan yang ada."
)
CLARIFY_NOTHING = "Maaf, tadi saya belum menangkap bagian yang membuat kamu bingung. Coba ceritakan keluhan utama dengan kalimat pendek: sejak kapan, gejala apa yang paling terasa, dan apakah ada sesak, perdarahan, muntah terus, pingsan, atau lemas sekali."
CLARIFY_ASK = "Apa keluhan utama yang paling terasa, sejak kapan, dan apakah ada tanda bahaya?"
#: By the first list of terms of which a question has one.
EXPLAINED = (
    (("sesak", "perdarahan", "muntah terus", "pingsan", "lemas", "memburuk"), "saya sedang mengecek tanda bahaya. Tanda bahaya itu misalnya napas terasa berat, muntah tidak berhenti, keluar darah, sangat lemas, pingsan, atau keluhan cepat memburuk."),
    (("suhu", "derajat", "demam"), "saya ingin tahu angka suhu tubuh tertinggi dan apakah ada tanda yang sering menyertai demam serius, seperti ruam, muntah, kaku leher, atau lemas berat."),
    (("skala", "1 sampai 10", "mengganggu", "berat"), "saya ingin tahu seberapa berat keluhanmu. Angka 1 berarti ringan, angka 10 berarti sangat berat."),
    (("sejak", "berapa lama", "mulai"), "saya ingin tahu kapan keluhan mulai muncul dan apakah sejak itu makin berat atau membaik."),
    ((), "saya ingin memastikan satu informasi penting dulu agar saran berikutnya tidak asal."),
)
TEMPERATURE = (
    "Saya perlu klarifikasi dulu ya. Suhu {value} derajat tidak sesuai dengan suhu tubuh manusia, jadi kemungkinan ada salah ketik atau salah dengar angka.\n\n{question}\n\n"
    "Kalau maksudnya 38 atau 39 derajat, tulis angkanya saja. Setelah itu saya lanjutkan penilaian gejalanya."
)
TEMPERATURE_ASK = "Boleh tulis ulang suhu tertingginya? Misalnya 38 derajat atau 39 derajat."
QUICK_REPLIES = {
    "follow_up": ["Tidak ada demam, tidak sesak, baru 1 hari.", "Keluhan makin berat dan ada tanda bahaya.", "Saya sudah jawab, lanjutkan anamnesis."],
    "recommendation": ["Rekomendasi ini membantu", "Belum membantu / kurang cocok", "Jelaskan cara pengolahan ramuan ini lebih detail"],
    "feedback": ["Cara pengolahan kurang jelas", "Bahan sulit didapat", "Mulai sesi baru"],
    "preparation_detail": ["Rekomendasi ini membantu", "Cara pengolahan kurang jelas", "Mulai sesi baru"],
    "medical_referral": ["Tolong rangkum alasan saya harus diperiksa.", "Apa tanda bahaya yang harus saya waspadai?", "Mulai sesi baru"],
    "out_of_scope": ["Saya mau cek keluhan lain.", "Keluhan saya mual ringan sejak tadi pagi.", "Mulai sesi baru"],
    "red_flag": ["Tolong rangkum tanda bahaya yang terdeteksi.", "Saya akan mulai sesi baru.", "Mulai sesi baru"],
}
#: Most tokens of an answer by response type.
TOKENS = {"default": 220, "recommendation": 640, "follow_up": 240, "red_flag": 120, "out_of_scope": 120}
