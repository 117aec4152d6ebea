"""Suffixes and placeholders for inputs and embedded objects."""

# Suffixes the text and table readers accept, and media suffixes.
SUPPORTED_SUFFIXES = (".txt", ".csv", ".xlsx", ".docx", ".pdf", ".pptx")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".svg")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".mpeg", ".mpg")
AUDIO_SUFFIXES = (".mp3", ".wav", ".aac", ".ogg", ".flac", ".m4a", ".wma", ".opus", ".aiff")

# Placeholders for removed objects.
IMAGE_REMOVED = "[BILDE FJERNET — KAN INNEHOLDE PII]"
VIDEO_REMOVED = "[VIDEO FJERNET — KAN INNEHOLDE PII]"
AUDIO_REMOVED = "[LYD FJERNET — KAN INNEHOLDE PII]"
MEDIA_REMOVED = "[MEDIAFIL FJERNET — KAN INNEHOLDE PII]"
COMMENT_REMOVED = "[KOMMENTAR FJERNET — KAN INNEHOLDE PII]"
