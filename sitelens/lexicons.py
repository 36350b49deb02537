"""Word lists as data.  Larger lexicons are passed in as tables (category, category_rank, term, term_rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Indicator phrases.
NEGATIVE = ["지원하지 않음", "불가능", "제한", "없음", "미지원", "not supported", "unavailable", "아직 개발 중", "준비 중", "coming soon", "under development", "프리미엄 기능", "유료 기능", "premium feature", "paid feature", "제한적 지원", "limited support", "partial support"]
POSITIVE = ["지원", "가능", "제공", "available", "supported", "enabled", "완전 지원", "full support", "comprehensive support", "무료 제공", "free", "included", "기본 기능", "basic feature"]
KEYWORD_NEGATIVE = ["지원하지 않음", "불가능", "제한", "없음", "미지원", "not supported", "unavailable", "not available", "limited"]
ADVANCED = ["video", "call", "meeting", "conference", "화상", "회의", "통화", "bot", "chatbot", "automation", "봇", "자동화", "api", "integration", "연동", "analytics", "report", "분석", "리포트"]
SUPPORT = ["support", "available", "feature", "include", "provide", "offer", "지원", "제공", "포함", "기능", "사용 가능", "이용 가능"]
DENIAL = ["not support", "not available", "not include", "not provide", "미지원", "지원하지 않음", "제공하지 않음", "포함하지 않음"]
BASIC = ["chat", "message", "채팅", "메시지"]
HELP_LINKS = ["help", "guide", "docs", "documentation", "faq", "support", "tutorial", "manual"]
MOBILE, DESKTOP = ["앱", "모바일", "ios", "android"], ["데스크톱", "pc", "윈도우", "mac"]
BUSINESS, DEVELOPER = ["기업", "비즈니스", "회사", "조직"], ["개발자", "프로그래머", "코딩"]
REMOVED_TAGS = ["script", "style", "nav", "footer", "header", "aside", "iframe", "noscript", "meta", "link", "form", "button", "input", "select", "textarea", "label", "fieldset"]
REMOVED_CLASSES = ["navigation", "menu", "sidebar", "footer", "header", "breadcrumb", "pagination", "comment", "advertisement", "popup", "modal", "overlay", "tooltip", "cookie"]
REMOVED_TAGS_PLAIN = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "embed", "object", "meta", "link", "title", "head"]
REMOVED_SELECTOR_TAGS, REMOVED_SELECTOR_CLASSES = ["nav", "footer", "header", "aside", "sidebar", "script", "style", "noscript"], ["advertisement", "ads", "banner", "popup", "cookie-notice", "newsletter", "social-share"]
CONTENT_TAGS, CONTENT_CLASSES = ["main", "article"], ["content", "main-content", "post-content", "entry-content", "page-content", "help-content", "documentation", "article-content", "text-content", "body-content"]

# Feature categories.
CATEGORIES = {
    "채팅": ["채팅", "메시지", "대화", "커뮤니케이션", "소통"],
    "파일": ["파일", "업로드", "다운로드", "문서", "첨부"],
    "통화": ["통화", "음성", "화상", "콜", "전화"],
    "보안": ["보안", "암호화", "인증", "권한", "접근"],
    "통합": ["통합", "연동", "API", "연결", "동기화"],
    "관리": ["관리", "설정", "관리자", "제어", "모니터링"],
    "분석": ["분석", "리포트", "통계", "데이터", "인사이트"],
    "검색": ["검색", "찾기", "필터", "쿼리", "탐색"],
    "알림": ["알림", "푸시", "이메일", "SMS"],
    "결제": ["결제", "구독", "요금", "청구"],
}

#: The corpus of the queries is invented English prose, so they use short words that occur in it.
SAMPLE_CATEGORIES = {"reach": ["data", "bot", "api", "free"], "function": ["the", "of", "and", "for"], "place": ["with", "on", "in"], "rare": ["chat", "file upload", "idiot"]}

# Synonym groups of feature names, a main word with its variants.
SYNONYMS = {
    "chat": ["채팅", "메시지", "대화", "message", "messaging", "커뮤니케이션"],
    "message": ["메시지", "채팅", "대화", "chat", "messaging", "커뮤니케이션"],
    "file": ["파일", "문서", "document", "upload", "첨부"],
    "upload": ["업로드", "파일", "upload", "file", "첨부"],
    "download": ["다운로드", "download", "파일", "저장"],
    "search": ["검색", "search", "find", "찾기", "검색기능"],
    "setting": ["설정", "setting", "config", "configuration", "관리"],
    "notification": ["알림", "notification", "alert", "알림", "공지"],
    "security": ["보안", "security", "safety", "protection", "안전"],
    "api": ["api", "연동", "integration", "interface", "통합"],
    "mobile": ["모바일", "mobile", "phone", "스마트폰", "휴대폰"],
    "desktop": ["데스크톱", "desktop", "pc", "컴퓨터", "pc앱"],
    "voice": ["음성", "voice", "audio", "통화", "음성통화"],
    "video": ["비디오", "video", "화상", "영상", "화상통화"],
    "meeting": ["회의", "meeting", "conference", "화상회의", "컨퍼런스"],
    "bot": ["봇", "bot", "자동화", "automation", "자동"],
    "permission": ["권한", "permission", "access", "authorization", "접근"],
    "backup": ["백업", "backup", "복원", "restore", "저장"],
    "sync": ["동기화", "sync", "synchronization", "동기"],
    "analytics": ["분석", "analytics", "통계", "statistics", "데이터"],
    "monitoring": ["모니터링", "monitoring", "감시", "추적", "데이터 모니터링"],
    "data": ["데이터", "data", "정보", "자료"],
    "report": ["리포트", "report", "보고서", "통계"],
    "dashboard": ["대시보드", "dashboard", "현황", "개요"],
    "user": ["사용자", "user", "계정", "account", "멤버"],
    "team": ["팀", "team", "그룹", "group", "조직"],
    "channel": ["채널", "channel", "방", "room", "공간"],
    "server": ["서버", "server", "워크스페이스", "workspace"],
    "integration": ["통합", "integration", "연동", "연결", "connect"],
    "automation": ["자동화", "automation", "자동", "auto", "봇"],
    "workflow": ["워크플로우", "workflow", "프로세스", "process", "흐름"],
}
# Feature names with their other names.
FEATURE_SYNONYMS = {
    "실시간 채팅": ["실시간 메시징", "라이브 채팅", "인스턴트 메시징", "real-time chat", "live chat", "instant messaging"],
    "그룹 채팅": ["팀 채팅", "채널 채팅", "멀티 채팅", "group chat", "team chat", "channel chat"],
    "개인 메시지": ["DM", "다이렉트 메시지", "1:1 채팅", "private message", "direct message"],
    "파일 공유": ["파일 업로드", "파일 전송", "문서 공유", "file sharing", "file upload", "document sharing"],
    "이미지 공유": ["사진 공유", "그림 공유", "image sharing", "photo sharing"],
    "화상 회의": ["비디오 통화", "화상 통화", "영상 회의", "video call", "video conference", "web conference"],
    "음성 통화": ["보이스 콜", "전화 통화", "voice call", "audio call"],
    "모바일 앱": ["스마트폰 앱", "휴대폰 앱", "mobile app", "smartphone app"],
    "데스크톱 앱": ["PC 앱", "컴퓨터 앱", "desktop app", "computer app"],
    "웹 앱": ["브라우저 앱", "웹 기반", "web app", "browser app"],
    "봇 연동": ["챗봇", "자동 응답", "봇 설정", "bot integration", "chatbot", "auto response"],
    "자동화": ["워크플로우", "자동 처리", "automation", "workflow"],
    "API 제공": ["개발자 API", "API 연동", "developer api", "api integration"],
    "웹훅": ["webhook", "이벤트 알림", "event notification"],
    "보안 설정": ["보안 관리", "권한 설정", "security settings", "access control"],
    "관리자 도구": ["관리 패널", "어드민 도구", "admin tools", "management panel"],
    "푸시 알림": ["알림 설정", "메시지 알림", "push notification", "message alert"],
    "이메일 알림": ["메일 알림", "email notification", "email alert"],
    "메시지 검색": ["채팅 검색", "대화 검색", "message search", "chat search"],
    "필터링": ["메시지 필터", "content filtering", "message filter"],
    "테마 설정": ["색상 테마", "디자인 커스터마이징", "theme customization", "color theme"],
    "언어 설정": ["다국어 지원", "language settings", "multilingual support"],
    "메시지 백업": ["대화 백업", "채팅 백업", "message backup", "chat backup"],
    "동기화": ["데이터 동기화", "sync", "data synchronization"],
    "사용 통계": ["활용도 분석", "사용량 통계", "usage statistics", "analytics"],
    "리포팅": ["보고서 생성", "통계 리포트", "reporting", "statistics report"],
}
#: Other names of features that the queries ask for, in words that their corpus has.
SAMPLE_FEATURE_SYNONYMS = {"and then": ["afterwards", "idiot"], "steel door": ["bot", "iron door"]}

#: Groups of words that the part names of the queries have.
SAMPLE_SYNONYMS = {"steel": ["iron", "metal"], "small": ["tiny", "little"]}

#: English stop words for term weights.
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def as_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    """(category, category_rank, term, term_rank), exact repeats dropped; blank terms left out."""
    rows = [(c, i, t, j) for i, (c, terms) in enumerate(lexicon.items()) for j, t in enumerate(dict.fromkeys(terms)) if t.strip()]
    return spark.createDataFrame(rows, "category string, category_rank int, term string, term_rank int")
