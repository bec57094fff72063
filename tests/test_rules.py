"""Golden rows for the classification and relevance rules (whole-URL deny, same host, Unicode)."""

from pyspark.sql import functions as F

from sitelore.functions import rules


def classify(spark, rows):
    df = spark.createDataFrame(rows, "url string, title string")
    return [r[0] for r in df.select(rules.classify_content_type(F.col("url"), F.col("title"))).collect()]


def relevant(spark, rows):
    df = spark.createDataFrame(rows, "url string, base string")
    return [r[0] for r in df.select(rules.is_relevant(F.col("url"), F.col("base"))).collect()]


def test_file_and_path_rules(spark):
    rows = [("https://h/notes/3.PDF", None), ("https://h/files/deck.pptx", None), ("https://h/course/quiz_1.html", None),
            ("https://h/m/assignment;v=3", None), ("https://h/lab-2", None), ("https://h/lab-2#x", None),
            ("https://h/course/module-1/lecture-3", None), ("https://h/syllabus?v=1", None),
            ("https://h/week-2", None), ("https://h/news/5", None), ("https://h/media/clip.mp4", None),
            ("https://h/resources", None), ("https://h/about", None)]
    assert classify(spark, rows) == ["pdf", "reference", "quiz", "assignment", "project", "project", "lecture",
                                     "course_overview", "module", "announcement", "video", "reference", "other"]


def test_title_rules_and_unicode_boundaries(spark):
    rows = [("https://h/blog/x", "Midterm 3"), ("https://h/blog/x", "Hands-on LAB 2"),
            ("https://h/blog/x", "éexam notes"), ("https://h/blog/x", "Unit 4 intro"),
            ("https://h/blog/x", ""), ("https://h/blog/x", None), ("https://h/blog/x", "Course  Overview"),
            ("https://h/blog/x", "Announcements")]
    assert classify(spark, rows) == ["quiz", "project", "other", "module", "other", "other",
                                     "course_overview", "announcement"]


def test_deny_rules_search_whole_url(spark):
    rows = [("https://account.uni.edu/x", "account.uni.edu"), ("https://h.edu/authors/1", "h.edu"),
            ("https://h.edu/p?next=/login", "h.edu"), ("https://h.edu/a#top", "h.edu"),
            ("https://h.edu/a.js?v=1", "h.edu"), ("https://h.edu/a.js", "h.edu"),
            ("HTTPS://h.edu/x", "h.edu"), ("https://www.h.edu/x", "h.edu"), ("https://sub.h.edu/x", "h.edu"),
            ("https://other.org/x", ""), ("ftp://h.edu/x", "h.edu")]
    assert relevant(spark, rows) == [False, False, False, False, True, False, False, True, False, True, False]
