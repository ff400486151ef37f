"""Texts of generated training data. Places in braces are filled by columns."""

# Texts of the generated rows, in natural order.
EDUCATION = "Informasi ini bersifat edukasi awal, bukan diagnosis medis final dan bukan pengganti konsultasi tenaga kesehatan."
_CHATBOT = "Anda adalah chatbot edukasi kesehatan berbahasa Indonesia. "
#: Variants of a health topic: label of the topic, overview, care, system prompt and question. The empty one stands for variants that have no text of their own.
VARIANTS = ("overview", "triage", "follow_up", "prevention", "self_care")
TOPIC_LABEL = {
    "overview": "ringkasan gejala dan konteks",
    "triage": "triase awal dan tanda bahaya",
    "follow_up": "pertanyaan anamnesis lanjutan",
    "prevention": "pencegahan dan edukasi",
    "self_care": "self-care ringan dan batas aman",
}
OVERVIEW = {
    "follow_up": "Topik {title} berada pada kategori {group}. Sebelum memberi kesimpulan, perlu klarifikasi gejala utama, durasi, tingkat gangguan aktivitas, dan red flag.",
    "prevention": "Edukasi pencegahan untuk {title} perlu menyesuaikan kategori {group}. Ringkasan sumber: {excerpt}",
    "self_care": "Bila keluhan yang mengarah ke {title} masih ringan, edukasi awal dapat diberikan sambil tetap menilai red flag. Topik terkait: {related}.",
    "triage": "Triase awal {title} difokuskan pada durasi, progresivitas gejala, dan tanda bahaya. Ringkasan sumber: {excerpt}",
    "": "{title} dikaitkan dengan kategori {group}. Ringkasan sumber resmi: {excerpt}",
}
NO_RELATED = "belum ada topik terkait yang ditampilkan"
CARE = {
    "follow_up": "Gunakan maksimal tiga pertanyaan lanjutan yang paling relevan untuk {title}. Bila jawaban mengarah ke {warnings}, arahkan pemeriksaan medis.",
    "prevention": "Pencegahan dan monitoring mandiri hanya untuk konteks edukasi. Perlu pemeriksaan langsung bila ada {warnings}.",
    "self_care": "Self-care hanya untuk gejala ringan dan stabil. Jika muncul {warnings}, hentikan swaperawatan dan cari bantuan medis.",
    "": "Untuk {title}, prioritaskan anamnesis, evaluasi red flag, dan jangan memberikan klaim diagnosis final. Periksa ke tenaga kesehatan bila ada {warnings}.",
}
NO_WARNINGS = "tanda bahaya klinis"
TOPIC_DIAGNOSIS = "Topik ini dikurasi dari MedlinePlus dan dikaitkan dengan kategori {group}. Institut rujukan utama: {institute}."
INSTITUTE = "MedlinePlus"
TOPIC_SAFETY = "Segera cari bantuan medis bila muncul tanda bahaya, gejala memburuk cepat, atau keluhan tidak sesuai kategori ringan."
SYSTEM = {
    "follow_up": _CHATBOT + "Tugas Anda menyusun pertanyaan anamnesis yang tidak berulang, humanizing, dan aman.",
    "prevention": _CHATBOT + "Jelaskan pencegahan dan kapan perlu periksa tanpa mengklaim diagnosis final.",
    "self_care": _CHATBOT + "Jelaskan self-care ringan yang aman sambil menekankan red flag.",
    "": _CHATBOT + "Berikan ringkasan triase awal yang aman, singkat, dan tetap humanizing.",
}
QUESTION = {
    "follow_up": "Kalau keluhan pengguna mengarah ke {title}, pertanyaan anamnesis lanjutan apa yang sebaiknya diajukan?",
    "prevention": "Bagaimana pencegahan dan kapan perlu periksa bila ada gejala yang mengarah ke {title}?",
    "self_care": "Edukasi awal apa yang aman untuk kasus ringan yang mengarah ke {title} sambil tetap waspada?",
    "triage": "Tolong bantu triase awal untuk keluhan yang mungkin terkait {title}.",
    "": "Saya ingin ringkasan gejala, tanda bahaya, dan langkah awal untuk {title}.",
}
TOPIC_ANSWER = {
    "overview": "{overview}",
    "questions": "Pertanyaan anamnesis yang perlu ditanyakan:\n{questions}",
    "warnings": "Tanda bahaya yang perlu diwaspadai:\n{warnings}",
    "prevention": "Langkah pencegahan atau edukasi awal:\n{prevention}",
    "care": "{care}",
    "end": EDUCATION,
}
#: Answers about a disease, by focus.
FOCUS = {
    "triage": "Fokus jawaban: triase awal dan pertanyaan anamnesis.",
    "symptoms": "Fokus jawaban: gejala kunci dan pola keluhan yang perlu dikenali.",
    "red_flag": "Fokus jawaban: tanda bahaya dan kapan harus segera periksa.",
    "brief": "Fokus jawaban: edukasi ringkas yang aman.",
    "medical": "Fokus jawaban: alasan perlunya pemeriksaan medis/laboratorium.",
    "follow_up": "Fokus jawaban: pemantauan dan langkah lanjutan yang aman.",
    "herbal_boundary": "Fokus jawaban: batas penggunaan herbal pada penyakit serius/menular.",
    "": "Fokus jawaban: edukasi awal yang aman.",
}
TRIAGE_ANSWER = {
    "focus": "{focus}",
    "disease": "Untuk {audience}, fokus anamnesis awal adalah kemungkinan {disease}, tetapi ini bukan diagnosis medis final.",
    "overview": "Ringkasan singkat: {overview}",
    "symptoms": "Gejala kunci yang sering terkait: {symptoms}.",
    "questions": "Pertanyaan anamnesis utama:\n{questions}",
    "warnings": "Tanda bahaya yang harus diwaspadai:\n{warnings}",
    "diagnosis": "Pemeriksaan medis yang lazim: {diagnosis}",
    "care": "Keputusan awal: {care}\n\nJika gejala mengarah ke penyakit infeksi tropis, penyakit menular kronis, atau infeksi jamur yang luas/berulang, jangan menjadikan herbal sebagai terapi utama.",
    "end": EDUCATION,
}
PREVENTION_ANSWER = {
    "focus": "Fokus jawaban: pencegahan, edukasi komunitas, dan tanda bahaya untuk {audience}.",
    "disease": "Pencegahan {disease} yang bisa diprioritaskan:",
    "steps": "{steps}",
    "warnings": "Segera periksa bila muncul gejala berikut:\n{warnings}",
    "care": "Arahan tambahan: {care}\n\nUntuk penyakit serius atau menular, pencegahan lingkungan, perlindungan diri, dan pemeriksaan dini lebih penting daripada mengandalkan herbal sebagai terapi utama.",
    "end": EDUCATION,
}
NO_PREVENTION = "- Hindari faktor risiko utama yang disebutkan dalam dokumen sumber."
DISEASE = "penyakit"
#: An anamnesis in a user's words, and its answer.
COMPLAINT = "{profile} mengalami {symptoms} {duration}, rasanya {severity}. Saya {intent}. Saya ingin ramuan herbal, tapi tolong tanya dulu gejala yang perlu dipastikan."
ANAMNESIS = (
    "{opening} Fokus anamnesis awal adalah kemungkinan {condition}, tetapi hasil ini bukan diagnosis medis final.\n\nPertanyaan anamnesis utama:\n{questions}\n\nPertanyaan tanda bahaya:\n{flags}\n\n"
    "Keputusan awal: {action}\n\n{closing}\n\nSumber kurasi ringkas: {sources}."
)
#: Two questions about a catalogue record.
CATALOG = {
    "": "Saya mengalami {symptoms}. Tolong lakukan anamnesis singkat dan rekomendasikan ramuan herbal bila masih ringan.",
    "dosis": "Bagaimana cara membuat dan dosis {formula}?",
}
CATALOG_COMPLAINT, CATALOG_FORMULA = "keluhan ringan", "ramuan herbal"
