"""Lint rules as data: a condition over line facts or scope facts each, compiled for Spark or another SQL engine.

``line_facts`` computes what conditions see (masked text, neighbours, scope, block and
loop depth) with one sort per file.  All line rules then run in one pass: a text of
the codes whose condition holds, exploded.  Scope rules aggregate the facts once per
(file, scope).  In conditions ``m[column, pattern]`` is a case-blind regular
expression test and ``M[...]`` one with case; patterns hold to what Java and RE2 share.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as K
from re import _parser as P

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeprism.functions.tables import stored
from codeprism.functions.text import OPEN_STRING, STRING, bounded

#: Block keywords in both languages of the analysed code.
PROC, FUNC = "Процедура|Procedure", "Функция|Function"
END_PROC, END_FUNC = "КонецПроцедуры|EndProcedure", "КонецФункции|EndFunction"
IF, THEN, ELSIF, ELSE, END_IF = "Если|If", "Тогда|Then", "ИначеЕсли|ElsIf", "Иначе|Else", "КонецЕсли|EndIf"
LOOP, DO, END_LOOP = "Пока|While|Для|For", "Цикл|Do", "КонецЦикла|EndDo"
TRY, EXCEPT, END_TRY = "Попытка|Try", "Исключение|Except", "КонецПопытки|EndTry"
RETURN, RAISE, BREAK, CONTINUE = "Возврат|Return", "ВызватьИсключение|Raise", "Прервать|Break", "Продолжить|Continue"
NOT, TRUE, FALSE, VAR, EXPORT, VAL = "НЕ|Not", "Истина|True", "Ложь|False", "Перем|Var", "Экспорт|Export", "Знач|Val"
REGION, END_REGION = "#Область|#Region", "#КонецОбласти|#EndRegion"
BEGIN, COMMIT, ROLLBACK = "НачатьТранзакцию|BeginTransaction", "ЗафиксироватьТранзакцию|CommitTransaction", "ОтменитьТранзакцию|RollbackTransaction"
#: Names of regions that count as standard.
STANDARD_REGIONS = "ПрограммныйИнтерфейс|Public|СлужебныйПрограммныйИнтерфейс|Internal|СлужебныеПроцедурыИФункции|Private|ОбработчикиСобытий|EventHandlers|Инициализация|Initialize|ОписаниеПеременных|Variables"

ID = r"[\p{L}_][\p{L}\p{N}_]*"
STOP = r"(?:$|[^\p{L}\p{N}_])"


def starts(words: str) -> str:
    return rf"^(?:{words}){STOP}"


def call(words: str) -> str:
    return rf"(?:^|[^\p{{L}}\p{{N}}_.])(?:{words})\s*\("


def member(words: str) -> str:
    return rf"\.(?:{words})\s*\("


DELIMITER = starts("|".join([END_PROC, END_FUNC, ELSIF, ELSE, END_IF, END_LOOP, EXCEPT, END_TRY, REGION, END_REGION])) + "|^#|^$"
STRING_SUM = r"\+\s*\"\"|\"\"\s*\+"
CODE_COMMENT = rf"^//.*(?:;\s*$|{ID}\s*=\s*{ID}|{ID}\(.*\))"
LITERAL_IF = rf"^(?:{IF}|{ELSIF})\s+(?:{TRUE}|{FALSE})\s+(?:{THEN}){STOP}"
NEGATED_IF = rf"^(?:{IF}|{ELSIF})\s+(?:{NOT})\s"
HARD_PATH = r"\"(?:[A-Za-z]:\\|/(?:home|usr|var|etc|opt|tmp|mnt)(?:/|\"))"
#: Cyrillic letters that look like Latin ones, and Latin acronyms of platform names.
ALIKE = "АВЕКМНОРСТУХаеорсух"
ACRONYMS = "HTTPS?|JSON|XML|HTML|XDTO|XSLT?|ZIP|COM|SQL|FTP|URL|URI|PDF|SOAP|WSDL|OData|MD5|SHA|UUID|GUID|CSV|DBF|DOM|OLE|API|SMTP|IMAP|IP|ID"
LATIN, OTHER = "[A-Za-z]", "[Б-ДЖ-ЙЛПФЦ-Яб-джз-йк-нптфц-яЁё]"
_TOKEN = rf"[A-Za-z0-9_{ALIKE}]*"
LOOKS = rf"(?:^|[^\p{{L}}\p{{N}}_]){_TOKEN}(?:{LATIN}[0-9_]*[{ALIKE}]|[{ALIKE}][0-9_]*{LATIN}){_TOKEN}(?:$|[^\p{{L}}\p{{N}}_])"
_WORD, _TURN = r"[\p{L}\p{N}_]*", r"(?:[A-Za-z][\p{N}_]*[А-Яа-яЁё]|[А-Яа-яЁё][\p{N}_]*[A-Za-z])"
TWO_SCRIPTS = rf"{LATIN}[0-9_]*{OTHER}|{OTHER}[0-9_]*{LATIN}|{OTHER}{_WORD}{_TURN}|{_TURN}{_WORD}{OTHER}"
#: Directives, and handlers whose parameters are given.
AT_CLIENT, AT_SERVER = "^&(?:НаКлиенте|AtClient)", "^&(?:НаСервере|AtServer)"
COMMAND_HANDLER = r"^(?:Процедура|Procedure)\s+(?:ОбработкаКоманды|CommandProcessing)\s*\("
COMPLETION_HANDLER = r"^(?:Процедура|Procedure)\s+[\p{L}\p{N}_]*(?:Завершение|Completion)\s*\("
WRITE_HANDLER = r"^(?:Процедура|Procedure)\s+(?:ПередЗаписью|BeforeWrite|ПриЗаписи|OnWrite|ПередУдалением|BeforeDelete)\s*\("
FORM_MODULE = r"/Forms/.*/Ext/(?:Form/)?Module\.bsl$"
MIXED = r"[A-Za-z][\p{N}_]*[А-Яа-яЁё]|[А-Яа-яЁё][\p{N}_]*[A-Za-z]"
NUMBER = r"(?:^|[^\p{L}\p{N}_.])(?:[%s]|[0-9]{2,})(?:$|[^\p{L}\p{N}_.])"

#: Lines that begin a statement of their own, whatever the one before lacks; and a parameter: all up to a comma that stands neither in a literal nor in brackets.
BEGINS = starts("|".join([PROC, FUNC, END_PROC, END_FUNC, IF, ELSIF, ELSE, END_IF, LOOP, END_LOOP, TRY, EXCEPT, END_TRY, RETURN, RAISE, BREAK, CONTINUE, VAR]))
PARAMETER = r'(?:[^,"()]+|"[^"]*(?:""[^"]*)*"|\([^()]*\))+'

#: code, name, severity (E, W, I), on by default, condition.
LINE_RULES: list[tuple[str, str, str, bool, str]] = [
    ("BSL003", "NonExportMethodsInApiRegion", "W", True, f"head = 1 AND api = 1 AND NOT m[c, {bounded(EXPORT)}]"),
    ("BSL004", "EmptyCodeBlock", "W", True, f"m[c, {starts(EXCEPT)}] AND m[n1, {starts(END_TRY)}] OR m[c, {STOP}(?:{THEN})$] AND m[c, {starts(IF)}] AND m[n1, {starts(END_IF)}]"),
    ("BSL005", "UsingHardcodeNetworkAddress", "W", True, r'm[text, "(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?"|"\x5c\x5c[^"]+"]'),
    ("BSL006", "UsingHardcodePath", "W", True, f"m[text, {HARD_PATH}]"),
    ("BSL009", "SelfAssign", "W", True, "lhs <> '' AND lower(lhs) = lower(rhs)"),
    ("BSL010", "UselessReturn", "I", True, f"m[c, ^(?:{RETURN})\\s*;?$] AND m[n1, {starts(END_PROC)}]"),
    ("BSL012", "UsingHardcodeSecretInformation", "E", True, r'm[body, (?:пароль|password|pwd|secret|секрет|token|токен)[\p{L}\p{N}_]*\s*=\s*"[^"]+"]'),
    ("BSL013", "CommentedCode", "I", False, f"m[note, {CODE_COMMENT}] AND m[t1, {CODE_COMMENT}]"),
    ("BSL014", "LineLength", "I", True, "length(text) > 120"),
    ("BSL016", "NonStandardRegion", "I", True, f"m[c, {starts(REGION)}] AND NOT m[c, ^(?:{REGION})\\s+(?:{STANDARD_REGIONS})$]"),
    ("BSL017", "CommandModuleExportMethods", "W", True, f"head = 1 AND m[c, {bounded(EXPORT)}] AND m[file_path, /(?:Commands|Forms)/]"),
    ("BSL018", "RaiseExceptionWithLiteral", "W", False, rf'm[c, ^(?:{RAISE})\s*\(?""\)?;?$]'),
    ("BSL020", "NestedStatements", "W", True, f"depth > 4 AND m[c, {starts(IF + '|' + LOOP)}]"),
    ("BSL022", "DeprecatedMessage", "W", True, f"m[code, {call('Предупреждение|Warning|DoMessageBox')}]"),
    ("BSL023", "UsingServiceTag", "I", True, f"m[note, {bounded('TODO|FIXME')}]"),
    ("BSL024", "SpaceAtStartComment", "I", True, r"m[note, ^//[^\s/@&]]"),
    ("BSL025", "EmptyStatement", "W", True, r"m[c, ;\s*;]"),
    ("BSL026", "EmptyRegion", "I", True, f"m[c, {starts(REGION)}] AND m[n1, {starts(END_REGION)}]"),
    ("BSL027", "UsingGoto", "W", True, f"m[c, {starts('Перейти|Goto')}]"),
    ("BSL029", "MagicNumber", "I", True, f"m[code, {NUMBER % '2-9'}]"),
    ("BSL030", "SemicolonPresence", "I", True, f"head = 1 AND m[c, ;$]"),
    ("BSL033", "CreateQueryInCycle", "W", True, f"loops > 0 AND m[code, {member('Выполнить|Execute')}]"),
    ("BSL036", "IfConditionComplexity", "W", True, f"m[c, ^(?:{IF}|{ELSIF})\\s.*(?:\\s(?:И|ИЛИ|And|Or)\\s.*){{4,}}]"),
    ("BSL037", "OverrideBuiltinMethod", "W", True, f"head = 1 AND m[c, ^(?:{PROC}|{FUNC})\\s+(?:Сообщить|Message|Формат|Format|Найти|Find|Тип|Type|Число|Number|Строка|String|Дата|Date)\\s*\\(]"),
    ("BSL038", "StringConcatenationInLoop", "W", True, f"loops > 0 AND m[code, {STRING_SUM}]"),
    ("BSL039", "NestedTernaryOperator", "I", True, r"m[code, \?\s*\(.*\?\s*\(]"),
    ("BSL040", "UsingThisForm", "I", True, f"m[code, {bounded('ЭтаФорма|ThisForm')}] AND NOT m[file_path, /Forms/.*/Ext/Module\\.bsl$]"),
    ("BSL041", "NotifyDescriptionToModalWindow", "I", True, f"m[code, {bounded('ОписаниеОповещения|NotifyDescription')}] AND NOT (scope > 0 AND m[heading, {COMMAND_HANDLER}] AND m[directive, {AT_CLIENT}])"),
    ("BSL045", "MultilineStringLiteral", "I", True, r'm[c, ""$] AND m[n1, ^\+]'),
    ("BSL046", "MissingElseBranch", "I", True, f"m[c, {starts(END_IF)}] AND if_elsif = 1 AND if_else = 0"),
    ("BSL047", "MagicDate", "I", True, f"m[code, {call('ТекущаяДата|CurrentDate')}]"),
    ("BSL049", "UnconditionalExceptionRaise", "I", True, f"scope > 0 AND depth = 0 AND try_depth = 0 AND m[c, {starts(RAISE)}] AND NOT (m[p1, {starts(PROC + '|' + FUNC)}] AND m[n1, {starts(END_PROC + '|' + END_FUNC)}])"),
    ("BSL051", "UnreachableCode", "W", True, f"m[p1, {starts(RETURN + '|' + RAISE)}] AND m[p1, ;$] AND c <> '' AND NOT m[c, {DELIMITER}]"),
    ("BSL052", "IdenticalExpressions", "W", True, f"m[c, {LITERAL_IF}]"),
    ("BSL053", "ExecuteExternalCode", "W", True, f"m[code, {call('Выполнить|Execute')}]"),
    ("BSL054", "ExportVariables", "I", True, f"m[c, ^(?:{VAR})\\s.*[\\s](?:{EXPORT})\\s*;?$]"),
    ("BSL055", "ConsecutiveEmptyLines", "I", True, "t = '' AND t1 = ''"),
    ("BSL057", "DeprecatedInputDialog", "W", True, f"m[code, {call('Ввести(?:Строку|Число|Дату|Значение)|Input(?:String|Number|Date|Value)')}]"),
    ("BSL059", "BooleanLiteralComparison", "I", True, f"m[c, ^(?:{IF}|{ELSIF})\\s.*=\\s*(?:{TRUE}|{FALSE}){STOP}] AND NOT m[n1, {starts(END_IF)}]"),
    ("BSL060", "DoubleNegatives", "I", True, f"m[code, {bounded(f'(?:{NOT})' + chr(92) + 's+(?:' + NOT + ')')}]"),
    ("BSL061", "AbruptLoopExit", "I", True, f"m[c, {starts(BREAK)}] AND m[n1, {starts(END_LOOP)}]"),
    ("BSL066", "DeprecatedFind", "W", True, f"m[code, {call('Найти|Find')}]"),
    ("BSL067", "VarDeclarationAfterCode", "W", True, f"scope > 0 AND m[c, {starts(VAR)}] AND p1 <> '' AND NOT m[p1, {starts(VAR + '|' + PROC + '|' + FUNC)}]"),
    ("BSL069", "InfiniteLoop", "W", True, f"m[c, ^(?:Пока|While)\\s+(?:{TRUE})\\s+(?:{DO})] AND loop_break = 0"),
    ("BSL070", "EmptyLoopBody", "W", True, f"m[c, {starts(LOOP)}] AND m[c, {STOP}(?:{DO})$] AND m[n1, {starts(END_LOOP)}]"),
    ("BSL071", "MagicNumber", "I", False, f"scope > 0 AND m[code, {NUMBER % '3-9'}]"),
    ("BSL072", "StringConcatenationInLoop", "W", False, f"loops > 0 AND first_lhs <> '' AND lower(first_lhs) = lower(first_rhs) AND m[code, {STRING_SUM}]"),
    ("BSL073", "MissingElseBranch", "I", False, f"m[c, {starts(END_IF)}] AND if_elsif = 1 AND if_else = 0"),
    ("BSL074", "TodoComment", "I", False, f"m[note, {bounded('TODO|FIXME')}]"),
    ("BSL076", "NegativeConditionFirst", "I", False, f"m[c, {NEGATED_IF}]"),
    ("BSL078", "RaiseWithoutMessage", "W", False, f"m[c, ^(?:{RAISE})\\s*;?$]"),
    ("BSL079", "UsingGoto", "W", False, f"m[c, {starts('Перейти|Goto')}]"),
    ("BSL080", "EmptyCodeBlock", "W", False, f"m[c, {starts(EXCEPT)}] AND handled = 0"),
    ("BSL081", "LongMethodChain", "I", False, rf"m[code, (?:\.{ID}\([^()]*\)){{5,}}]"),
    ("BSL085", "IdenticalExpressions", "W", False, f"m[c, {LITERAL_IF}]"),
    ("BSL086", "HttpRequestInLoop", "W", False, f"loops > 0 AND m[code, HTTPСоединение|HTTPConnection|HTTPЗапрос|HTTPRequest]"),
    ("BSL087", "ObjectCreationInLoop", "I", False, f"loops > 0 AND m[code, {bounded('(?:Новый|New)' + chr(92) + 's+' + ID)}] AND NOT m[code, (?:Новый|New)\\s+(?:Структура|Structure|Массив|Array|Соответствие|Map)]"),
    ("BSL089", "TransactionInLoop", "W", False, f"loops > 0 AND m[code, {call(BEGIN)}]"),
    ("BSL090", "UsingHardcodeSecretInformation", "W", False, r'm[text, "[^"]*(?:Server|Srvr)=[^"]*;[^"]*Pwd=]'),
    ("BSL091", "RedundantElseAfterReturn", "I", False, f"m[c, {starts(ELSE)}] AND m[p1, {starts(RETURN)}]"),
    ("BSL092", "EmptyCodeBlock", "W", False, f"m[c, {starts(ELSE)}] AND m[n1, {starts(END_IF)}]"),
    ("BSL093", "ComparisonToNull", "W", False, f"m[code, =\\s*NULL{STOP}]"),
    ("BSL094", "SelfAssign", "W", False, r"m[code, \+=\s*0\s*;]"),
    ("BSL095", "MultipleStatementsOnOneLine", "I", False, r"m[c, ;\s*[^\s;]]"),
    ("BSL097", "DeprecatedCurrentDate", "I", True, f"m[code, {call('ТекущаяДата|CurrentDate')}]"),
    ("BSL098", "UseOfExecute", "W", False, f"m[code, {call('Выполнить|Execute')}]"),
    ("BSL100", "UsingHardcodePath", "W", False, f"m[text, {HARD_PATH}]"),
    ("BSL101", "NestedStatements", "W", False, f"depth > 6 AND m[c, {starts(IF + '|' + LOOP)}]"),
    ("BSL103", "UseOfEval", "W", False, f"m[code, {call('Вычислить|Eval')}]"),
    ("BSL105", "UseOfSleep", "W", False, f"m[code, {call('Приостановить|Sleep')}]"),
    ("BSL106", "CreateQueryInCycle", "W", False, f"loops > 0 AND m[code, (?:Новый|New)\\s+(?:Запрос|Query)]"),
    ("BSL107", "EmptyCodeBlock", "W", False, f"m[c, {starts(IF)}] AND m[c, {STOP}(?:{THEN})$] AND m[n1, {starts(END_IF)}]"),
    ("BSL108", "ExportVariables", "W", False, f"m[c, ^(?:{VAR})\\s.*[\\s](?:{EXPORT})\\s*;?$]"),
    ("BSL109", "NegativeConditionalReturn", "I", False, f"m[c, {NEGATED_IF}] AND m[n1, {starts(RETURN)}]"),
    ("BSL110", "StringConcatInLoop", "W", False, f"loops > 0 AND m[code, {STRING_SUM}]"),
    ("BSL111", "MixedLanguageIdentifiers", "W", True, f"m[code, {MIXED}]"),
    ("BSL115", "DoubleNegatives", "W", False, f"m[code, {bounded(f'(?:{NOT})' + chr(92) + 's+(?:' + NOT + ')')}]"),
    ("BSL116", "UseOfObsoleteIterator", "I", False, rf"m[c, ^(?:Для|For)\s+{ID}\s*=]"),
    ("BSL119", "LineLength", "I", False, "length(text) > 120"),
    ("BSL120", "TrailingWhitespace", "I", False, r"m[text, \s$]"),
    ("BSL121", "TabIndentation", "I", False, r"m[text, ^\t]"),
    ("BSL123", "CommentedCode", "I", False, f"m[note, {CODE_COMMENT}]"),
    ("BSL125", "UseOfAbortOutsideLoop", "E", True, f"loops = 0 AND m[c, {starts(BREAK)}]"),
    ("BSL126", "UseOfContinueOutsideLoop", "E", True, f"loops = 0 AND m[c, {starts(CONTINUE)}]"),
    ("BSL128", "UnreachableCode", "W", False, f"scope > 0 AND depth = 0 AND try_depth = 0 AND m[p1, {starts(RETURN + '|' + RAISE)}] AND m[p1, ;$] AND c <> '' AND NOT m[c, {DELIMITER}]"),
    ("BSL130", "LineLength", "I", False, "length(note) > 120"),
    ("BSL131", "EmptyRegion", "I", False, f"m[c, {starts(REGION)}] AND m[n1, {starts(END_REGION)}]"),
    ("BSL135", "NestedFunctionCalls", "I", False, rf"m[code, {ID}\s*\([^()]*{ID}\s*\(]"),
    ("BSL136", "MissingSpaceBeforeComment", "I", False, r"m[masked, [^\s/]//]"),
    ("BSL137", "UseOfFindByDescription", "W", False, f"m[code, {member('НайтиПоНаименованию|FindByDescription')}]"),
    ("BSL138", "UseOfDebugOutput", "W", False, f"m[code, {call('Сообщить|Message')}]"),
    ("BSL140", "UnreachableElseIf", "W", True, f"m[c, {starts(ELSIF)}] AND else_before = 1"),
    ("BSL143", "DuplicateElseIfCondition", "W", True, f"m[c, {starts(ELSIF)}] AND asked_before > 0"),
    ("BSL144", "UnnecessaryParentheses", "I", False, f"m[c, ^(?:{RETURN})\\s*\\(.*\\)\\s*;?$] AND NOT m[c, \\(\\s*(?:Новый|New)\\s]"),
    ("BSL145", "StringFormatInsteadOfConcat", "I", False, r'm[code, ""\s*\+[^+]*\+\s*""|\+\s*""\s*\+]'),
    ("BSL146", "ModuleInitializationCode", "I", False, f"scope = 0 AND c <> '' AND NOT m[c, ^[#&]|{starts(VAR)}]"),
    ("BSL147", "UseOfUICall", "W", True, f"m[code, {call('ОткрытьФорму|OpenForm')}]"),
    ("BSL151", "BeginTransactionBeforeTryCatch", "E", False, f"m[code, {call(BEGIN)}] AND NOT m[n1, {starts(TRY)}]"),
    ("BSL153", "CanonicalSpellingKeywords", "I", False, f"m[c, {starts('|'.join([IF, ELSIF, ELSE, END_IF, LOOP, END_LOOP, RETURN, TRY, EXCEPT, END_TRY]))}] AND NOT M[c, {starts('|'.join([IF, ELSIF, ELSE, END_IF, LOOP, END_LOOP, RETURN, TRY, EXCEPT, END_TRY]))}]"),
    ("BSL157", "CommitTransactionOutsideTryCatch", "E", False, f"try_depth = 0 AND m[code, {call(COMMIT)}]"),
    ("BSL173", "DeletingCollectionItem", "E", False, f"loops > 0 AND m[code, {member('Удалить|Delete')}]"),
    ("BSL183", "ExecuteExternalCode", "W", False, f"m[code, {call('Выполнить|Execute')}]"),
    ("BSL186", "ExtraCommas", "W", False, r"m[code, ,\s*\)]"),
    ("BSL190", "FormDataToValue", "W", False, f"m[code, {bounded('ДанныеФормыВЗначение|FormDataToValue')}]"),
    ("BSL198", "IfElseDuplicatedCondition", "W", False, f"m[c, {starts(ELSIF)}] AND asked_before > 0"),
    ("BSL199", "IfElseIfEndsWithElse", "I", False, f"m[c, {starts(END_IF)}] AND if_elsif = 1 AND if_else = 0"),
    ("BSL208", "LatinAndCyrillicSymbolInWord", "W", False, f"M[bare, {TWO_SCRIPTS}]"),
    ("BSL216", "MissingSpace", "I", False, r"m[code, [\p{L}\p{N}_)]=|=[\p{L}\p{N}_(]]"),
    ("BSL219", "MissingVariablesDescription", "I", True, f"m[c, ^(?:{VAR})\\s.*[\\s](?:{EXPORT})\\s*;?$] AND NOT m[t1, ^//]"),
    ("BSL227", "OneStatementPerLine", "I", False, r"m[c, ;\s*[^\s;]]"),
    ("BSL254", "TransferringParametersBetweenClientAndServer", "W", False, f"head = 1 AND m[p1, {AT_SERVER}] AND m[c, \\(\\s*[^\\s)]] AND NOT m[c, ^[^(]*\\((?:\\s*(?:{VAL})\\s[^,]*(?:,|\\)))*[^,)]*$]"),
    ("BSL255", "TryNumber", "W", False, f"try_depth > 0 AND except_before = 0 AND m[code, {call('Число|Number')}]"),
    ("BSL256", "Typo", "I", True, f"M[bare, {LOOKS}]"),
    ("BSL257", "UnaryPlusInConcatenation", "W", False, r"m[code, \+\s*\+]"),
    ("BSL265", "UselessTernaryOperator", "W", False, f"m[code, \\?\\s*\\(.*,\\s*(?:{TRUE}|{FALSE})\\s*,\\s*(?:{TRUE}|{FALSE})\\s*\\)]"),
    ("BSL279", "YoLetterUsage", "I", False, r"m[text, ё]"),
]

#: Aggregates of one scope (a method from its header to its end) that scope conditions may name.
SCOPE_FACTS = {
    "n_lines": "count(*)",
    "n_returns": f"sum(CASE WHEN m[c, {starts(RETURN)}] THEN 1 ELSE 0 END)",
    "n_values": f"sum(CASE WHEN m[c, ^(?:{RETURN})\\s*[^;\\s]] THEN 1 ELSE 0 END)",
    "n_branches": f"sum(CASE WHEN m[c, {starts('|'.join([IF, ELSIF, LOOP, EXCEPT]))}] OR m[code, \\?\\s*\\(] THEN 1 ELSE 0 END)",
    "cognitive": f"sum(CASE WHEN m[c, {starts('|'.join([IF, LOOP, EXCEPT]))}] THEN greatest(depth, 1) WHEN m[c, {starts(ELSIF + '|' + ELSE)}] THEN 1 ELSE 0 END)",
    "n_begins": f"sum(CASE WHEN m[code, {call(BEGIN)}] THEN 1 ELSE 0 END)",
    "n_ends": f"sum(CASE WHEN m[code, {call(COMMIT + '|' + ROLLBACK)}] THEN 1 ELSE 0 END)",
    "n_elsif": f"sum(CASE WHEN m[c, {starts(ELSIF)}] THEN 1 ELSE 0 END)",
    "n_true": f"sum(CASE WHEN m[c, ^(?:{RETURN})\\s+(?:{TRUE})\\s*;] THEN 1 ELSE 0 END)",
    "n_false": f"sum(CASE WHEN m[c, ^(?:{RETURN})\\s+(?:{FALSE})\\s*;] THEN 1 ELSE 0 END)",
    "n_vars": f"sum(CASE WHEN m[c, {starts(VAR)}] THEN 1 ELSE 0 END)",
    "n_tries": f"sum(CASE WHEN m[c, {starts(TRY)}] THEN 1 ELSE 0 END)",
    "n_body": f"sum(CASE WHEN c <> '' AND head = 0 AND NOT m[c, {starts(END_PROC + '|' + END_FUNC)}] THEN 1 ELSE 0 END)",
    "header": "max(CASE WHEN head = 1 THEN m0 ELSE '' END)",
    "above": "max(CASE WHEN head = 1 THEN CASE WHEN t1 LIKE '&%' THEN t2 ELSE t1 END ELSE '' END)",
    "under": "max(CASE WHEN head = 1 THEN p1 ELSE '' END)",
    "n_own_returns": f"sum(CASE WHEN depth = 0 AND try_depth = 0 AND m[c, {starts(RETURN)}] THEN 1 ELSE 0 END)",
    "asks_load": "max(CASE WHEN m[code, (?:ОбменДанными|DataExchange)\\s*\\.\\s*(?:Загрузка|Load)] THEN 1 ELSE 0 END)",
    "line": "min(line)",
}
NAME_OF = f"^(?:{PROC}|{FUNC})\\s+({ID})"
SCOPE_RULES: list[tuple[str, str, str, bool, str]] = [
    ("BSL002", "MethodSize", "W", True, "n_lines > 200"),
    ("BSL008", "TooManyReturns", "W", True, "n_returns > 3"),
    ("BSL011", "CognitiveComplexity", "W", True, "cognitive > 15"),
    ("BSL019", "CyclomaticComplexity", "W", True, "n_branches + 1 > 10"),
    ("BSL028", "MissingCodeTryCatchEx", "I", True, "n_tries = 0"),
    ("BSL032", "FunctionShouldHaveReturn", "W", True, f"m[header, ^(?:{FUNC})\\s] AND n_returns = 0"),
    ("BSL042", "UnusedLocalMethod", "W", True, f"m[header, {bounded(EXPORT)}] AND n_body = 0"),
    ("BSL043", "TooManyVariables", "I", True, "n_vars > 15"),
    ("BSL044", "FunctionNoReturnValue", "W", True, f"m[header, ^(?:{FUNC})\\s] AND m[header, {bounded(EXPORT)}] AND n_values = 0"),
    ("BSL050", "LargeTransaction", "W", True, "n_begins > 0 AND n_ends = 0"),
    ("BSL056", "ShortMethodName", "I", True, "length(name) < 3"),
    ("BSL064", "ProcedureReturnsValue", "E", True, f"m[header, ^(?:{PROC})\\s] AND n_values > 0"),
    ("BSL065", "MissingReturnedValueDescription", "I", True, f"m[header, {bounded(EXPORT)}] AND NOT m[above, ^//] AND NOT m[file_path, {FORM_MODULE}] AND NOT (m[header, {COMPLETION_HANDLER}] AND m[under, {AT_CLIENT}])"),
    ("BSL068", "TooManyElseIf", "I", True, "n_elsif > 5"),
    ("BSL084", "FunctionShouldHaveReturn", "W", False, f"m[header, ^(?:{FUNC})\\s] AND n_values = 0"),
    ("BSL096", "MissingReturnedValueDescription", "I", False, f"m[header, {bounded(EXPORT)}] AND NOT m[above, ^//]"),
    ("BSL112", "UnterminatedTransaction", "E", False, "n_begins > 0 AND n_ends = 0"),
    ("BSL118", "FunctionShouldHaveReturn", "W", False, f"m[header, ^(?:{FUNC})\\s] AND n_returns = 0"),
    ("BSL124", "ShortProcedureName", "I", False, "length(name) < 3"),
    ("BSL127", "MultipleReturnValues", "I", False, "n_own_returns > 1"),
    ("BSL134", "CyclomaticComplexity", "W", False, "n_branches + 1 > 10"),
    ("BSL141", "MagicBooleanReturn", "I", False, "n_true > 0 AND n_false > 0"),
    ("BSL172", "DataExchangeLoading", "W", False, f"m[header, {WRITE_HANDLER}] AND asks_load = 0"),
    ("BSL230", "PairingBrokenTransaction", "E", False, "n_begins <> n_ends"),
]
#: Rules over parameters: aggregates of one header's parameters.
PARAM_RULES: list[tuple[str, str, str, bool, str]] = [
    ("BSL015", "NumberOfOptionalParams", "W", True, "n_optional > 3"),
    ("BSL031", "NumberOfParams", "W", True, "n_params > 7"),
    ("BSL099", "NumberOfParams", "W", False, "n_params > 7"),
    ("BSL133", "RequiredParamAfterOptional", "W", True, "last_required > first_optional"),
    ("BSL139", "TooLongParameterName", "I", False, "longest > 30"),
    ("BSL142", "LargeParameterDefaultValue", "I", False, "longest_default > 50"),
]
#: Rules over whole modules.
FILE_FACTS = {"n_lines": "count(*)", "n_code": "sum(CASE WHEN c <> '' THEN 1 ELSE 0 END)", "n_module_vars": f"sum(CASE WHEN scope = 0 AND m[c, {starts(VAR)}] THEN 1 ELSE 0 END)", "opening": "max(CASE WHEN line = 1 THEN t ELSE '' END)", "lowest": "min(depth)", "last_depth": "max_by(depth, line)",
    "n_heads": "sum(head)", "n_tails": f"sum(CASE WHEN m[c, {starts(END_PROC + '|' + END_FUNC)}] THEN 1 ELSE 0 END)", "n_try": f"sum(CASE WHEN m[c, {starts(TRY)}] THEN 1 ELSE 0 END)", "n_end_try": f"sum(CASE WHEN m[c, {starts(END_TRY)}] THEN 1 ELSE 0 END)"}
FILE_RULES: list[tuple[str, str, str, bool, str]] = [
    ("BSL001", "ParseError", "E", True, "lowest < 0 OR last_depth <> 0 OR n_heads <> n_tails OR n_try <> n_end_try"),
    ("BSL048", "EmptyFile", "I", True, "n_code = 0"),
    ("BSL063", "LargeModule", "W", True, "n_lines > 1000"),
    ("BSL083", "TooManyModuleVariables", "I", False, "n_module_vars > 10"),
    ("BSL102", "LargeModule", "I", False, "n_lines > 500"),
    ("BSL104", "MissingModuleComment", "I", False, "NOT m[opening, ^//]"),
    ("BSL114", "EmptyModule", "I", False, "n_code = 0"),
]
#: Rules over the text q of string literals that are queries, loops deep in loops; unaliased is a list of fields without alias.
QUERY_TEXT = r"^\s*(?:ВЫБРАТЬ|SELECT|ОБЪЕДИНИТЬ|UNION)(?:\s|$)"
FIELDS = r"(?iu)^\s*(?:ВЫБРАТЬ|SELECT)\s+(?:(?:РАЗЛИЧНЫЕ|DISTINCT|РАЗРЕШЕННЫЕ|ALLOWED)\s+|(?:ПЕРВЫЕ|TOP)\s+[0-9]+\s+)*(.*?)\s(?:ИЗ|FROM)\s"
ALIASED = r"(?iu)\s(?:КАК|AS)\s|\*\s*$"
UNION_ALL = r"(?iu)(?:ОБЪЕДИНИТЬ|UNION)\s+(?:ВСЕ|ALL)"
QUERY_RULES: list[tuple[str, str, str, bool, str]] = [
    ("BSL058", "QueryWithoutWhere", "W", True, r"m[q, ^\s*(?:ВЫБРАТЬ|SELECT)\s] AND m[q, \s(?:ИЗ|FROM)\s] AND NOT m[q, \s(?:ГДЕ|WHERE|ПЕРВЫЕ|TOP)\s]"),
    ("BSL077", "SelectTopWithoutOrderBy", "W", True, r"m[q, (?:ВЫБРАТЬ|SELECT)\s+\*]"),
    ("BSL106", "CreateQueryInCycle", "W", False, r"loops > 0 AND m[q, ^\s*(?:ВЫБРАТЬ|SELECT)\s]"),
    ("BSL149", "AssignAliasFieldsInQuery", "I", True, "unaliased > 0"),
    ("BSL258", "UnionAll", "W", False, r"m[rest, (?:^|\s)(?:ОБЪЕДИНИТЬ|UNION)(?:\s|$)]"),
]
ALL_RULES = [*LINE_RULES, *SCOPE_RULES, *PARAM_RULES, *FILE_RULES, *QUERY_RULES]
SEVERITY = {"E": "ERROR", "W": "WARNING", "I": "INFORMATION"}


#: Letters that a case-blind test takes for others, beside those that lower() folds.
FOLDS = ("İıſ\u212aᲀᲁᲂᲃᲄᲅᲆ", "iiskвдосттъ")


def folded(column: str) -> str:
    """Spark SQL for ``column`` in lower case, as a case-blind test folds it; ASCII holds none of the other letters."""
    return f"CASE WHEN octet_length({column}) = length({column}) THEN lower({column}) ELSE lower(translate({column}, '{FOLDS[0]}', '{FOLDS[1]}')) END"


def needed(pattern: str) -> set[str]:
    """Literals of which every match of ``pattern`` holds one at least (empty: none is known)."""

    def of(sequence) -> set[str]:
        found, run = [], ""
        for op, at in [*sequence, (None, None)]:
            if op is K.LITERAL:
                run += chr(at)
                continue
            found, run = found + ([{run}] if run else []), ""
            if op is K.SUBPATTERN:
                found.append(of(at[3]))
            elif op is K.BRANCH:
                each = [of(x) for x in at[1]]
                found.append(set().union(*each) if all(each) else set())
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and at[0]:
                found.append(of(at[2]))
        return max(filter(None, found), key=lambda x: (min(map(len, x)), -len(x)), default=set())

    return of(P.parse(re.sub(r"\\p\{(?:L|N)\}", r"\\w", pattern)))


def guard(column: str, pattern: str, blind: bool, folds: set[str]) -> str:
    """Spark SQL that is true wherever ``pattern`` matches and cheap to tell: one of its literals occurs.

    Letters are looked for in the folded column ``f_<column>``, where ``folds`` has it.
    """
    if pattern == MIXED:
        return f"octet_length({column}) > length({column}) AND "
    words = {w.lower() for w in needed(pattern)} if blind else needed(pattern)
    if any("'" in w or "\\" in w for w in words) or blind and column not in folds and any(w.upper() != w or not w.isascii() for w in words):
        return ""
    name = f"f_{column}" if blind and column in folds else column
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in sorted(words)) + ") AND " if words else ""


def compiled(condition: str, engine: str = "spark", folds: set[str] | None = None) -> str:
    """A condition as SQL for ``engine`` (spark or duckdb); with ``folds`` (columns that have a folded one) tests are guarded."""
    out, at = [], 0
    for found in re.finditer(r"\b([mM])\[(\w+), ", condition):
        if found.start() < at:
            continue
        depth, end = 1, found.end()
        while depth:  # to the bracket that closes the test; classes in the pattern are balanced, escaped brackets don't count
            depth += {"[": 1, "]": -1}.get(condition[end], 0) if condition[end - 1] != "\\" else 0
            end += 1
        pattern = condition[found.end() : end - 1].replace("'", "''")
        flags = "" if found[1] == "M" else "(?iu)" if engine == "spark" else "(?i)"
        test = f"({found[2]} RLIKE r'{flags}{pattern}')" if engine == "spark" and "'" not in pattern else f"regexp_matches({found[2]}, '{flags}{pattern}')"
        if engine == "spark" and folds is not None:
            test = f"({guard(found[2], condition[found.end() : end - 1], found[1] == 'm', folds)}{test})"
        out += [condition[at : found.start()], test]
        at = end
    return "".join([*out, condition[at:]])


#: Kinds of blocks with the words that open and close them.
KINDS = {"if": (IF, END_IF), "loop": (LOOP, END_LOOP), "try": (TRY, END_TRY)}
ERROR_TEXT = f"ИнформацияОбОшибке|ErrorInfo|ОписаниеОшибки|ErrorDescription|{RAISE}"
#: Names of the region of public methods.
API_REGION = rf"^(?:{REGION})\s+(?:ПрограммныйИнтерфейс|Public)$"
CONDITION = rf"^(?:{IF}|{ELSIF})\s+(.*)\s(?:{THEN})$"


def strings_sql(lines: str, engine: str = "duckdb") -> str:
    """Lines with inside (1: the line begins within a string literal), lead, code, note and masked, as SQL for ``engine``.

    A line takes the state "within a string" to that of the next line: it keeps it, turns
    it, or sets it whatever it was (a quote behind ``//``).  The state a line begins in is
    that of the last line that set it, turned as often as lines since then turn it, so one
    window over the file finds it.  lead is the line with a quote in front if it begins
    inside, body the line without its comment; code is body with literals emptied, note the comment.
    """
    spark = engine == "spark"
    both = f"{OPEN_STRING}|//.*"
    every = (lambda c: f"regexp_extract_all({c}, r'{both}', 0)") if spark else (lambda c: f"regexp_extract_all({c}, '{both}')")
    final = (lambda a: f"coalesce(try_element_at({a}, -1), '')") if spark else (lambda a: f"coalesce({a}[-1], '')")
    odd = lambda x: f"CASE WHEN {x} LIKE '\"%' THEN (length({x}) - length(replace({x}, '\"', ''))) % 2 ELSE 0 END"
    emptied = f"regexp_replace(body, r'{OPEN_STRING}', '\"\"')" if spark else f"regexp_replace(body, '{OPEN_STRING}', '\"\"', 'g')"
    last = lambda v: f"last_value({v}) IGNORE NULLS" if spark else f"last_value({v} IGNORE NULLS)"
    w, before = "PARTITION BY file_path ORDER BY line", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""SELECT file_path, line, text, inside, lead, CASE WHEN inside = 1 THEN substr(body, 2) ELSE body END AS body, code, note, code || note AS masked FROM (SELECT *, CASE WHEN contains(body, '"') THEN {emptied} ELSE body END AS code FROM (
      SELECT *, left(lead, CAST(length(lead) - length(note) AS INT)) AS body FROM (SELECT *, CASE WHEN tail LIKE '//%' THEN tail ELSE '' END AS note FROM (
      SELECT *, CASE WHEN contains(lead, '"') OR contains(lead, '//') THEN {final(every('lead'))} ELSE '' END AS tail FROM (
      SELECT file_path, line, text, inside, CASE WHEN inside = 1 THEN '"' || text ELSE text END AS lead FROM (
      SELECT *, CAST((coalesce({last("CASE WHEN from_out = from_in THEN (from_out + turned) % 2 END")} OVER ({w} {before}), 0) + turned - turns) % 2 AS INT) AS inside FROM (
      SELECT *, sum(turns) OVER ({w}) AS turned FROM (SELECT *, CASE WHEN from_out = 1 AND from_in = 0 THEN 1 ELSE 0 END AS turns FROM (
      SELECT file_path, line, text, {odd('out_tail')} AS from_out, {odd('in_tail')} AS from_in FROM (
      SELECT file_path, line, text, CASE WHEN contains(text, '"') THEN {final(every('text'))} ELSE '' END AS out_tail, CASE WHEN contains(text, '"') THEN {final(every("'\"' || text"))} ELSE '"' END AS in_tail FROM {lines}
      ) s1) s2) s3) s4) s5) s6) s7) s8) s9) s10"""


def facts_sql(lines: str, engine: str = "duckdb") -> str:
    """What line conditions see of each line of relation ``lines`` (file_path, line, text), as SQL for ``engine``.

    p1 and n1 are the code of the nearest lines before and after that have any; t1 is the
    line above as it stands, t2 the one above it.  heading and directive are the header of the
    method that began last and the code line above it.  bare is code with two scripts less its
    acronyms.  scope numbers the method a line belongs to (0: none, its end
    included).  A block of a kind has a number within its depth, so what it holds at its
    own level comes from windows over (file, depth, number): an If chain's ElsIf and Else,
    a loop's Break, a handler's use of the error.
    """
    spark = engine == "spark"
    m = lambda column, pattern: compiled(f"m[{column}, {pattern}]", engine, {"c", "code"})
    flag = lambda column, pattern: f"CASE WHEN {m(column, pattern)} THEN 1 ELSE 0 END"
    raw = (lambda pattern: f"r'{pattern}'") if engine == "spark" else (lambda pattern: f"'{pattern}'")
    every = "" if engine == "spark" else ", 'g'"
    first = lambda column, pattern, group=1: f"regexp_extract({column}, {raw(pattern)}, {group})"
    blind = "(?iu)" if engine == "spark" else "(?i)"
    trim = lambda column: f"trim(BOTH ' \t' FROM {column})" if engine == "spark" else f"trim({column}, ' ' || chr(9))"
    last = lambda value: f"last_value({value}) IGNORE NULLS" if engine == "spark" else f"last_value({value} IGNORE NULLS)"
    sides = rf"^({ID})\s*=\s*({ID})\s*;?$"
    opens = ", ".join(f"{flag('c', starts(o))} AS {k}_opens, {flag('c', starts(x))} AS {k}_closes" for k, (o, x) in KINDS.items())
    depths = ", ".join(f"sum({k}_opens) OVER (w) - sum({k}_closes) OVER (w) + {k}_closes AS {k}_depth" for k in KINDS)
    numbers = ", ".join(f"sum({k}_opens) OVER (PARTITION BY file_path, {k}_depth ORDER BY line) AS {k}_id" for k in KINDS)
    # Spark takes windows of one order together, so n1 is a lead there and needs no sort of its own, and extractions run only where they can match.
    n1 = f"""coalesce({"lead(CASE WHEN c <> '' THEN c END) IGNORE NULLS OVER (w)" if spark else last("CASE WHEN c <> '' THEN c END") + " OVER (later)"}, '') AS n1, """
    # fresh: the first line of a file, or one behind a line that opens or closes an If or has a condition (see BLOCK_LINES).
    fresh = "lag(CASE WHEN if_opens + if_closes > 0 OR asked <> '' THEN 1 ELSE 0 END, 1, 1) OVER (w) AS fresh, " if spark else ""
    # unclosed: whether the header that began last has brackets open at the end of its line, so that lines behind it may belong to it.
    net = "CASE WHEN head = 1 THEN CAST(length(replace(code, ')', '')) > length(replace(code, '(', '')) AS INT) END"
    unclosed = f"coalesce({last(net)} OVER (w), 0) AS unclosed, " if spark else ""
    begun = f"""{last("CASE WHEN head = 1 THEN c END")} OVER (PARTITION BY file_path ORDER BY line) AS heading, {last("CASE WHEN head = 1 THEN p1 END")} OVER (PARTITION BY file_path ORDER BY line) AS directive"""
    if spark:
        plain = first
        first = lambda column, pattern, group=1: f"CASE WHEN contains({column}, '=') THEN {plain(column, pattern, group)} ELSE '' END"
        asked = f"CASE WHEN {guard('c', CONDITION, True, {'c'})}true THEN lower({plain('c', blind + CONDITION)}) ELSE '' END"
    else:
        asked = f"lower({first('c', blind + CONDITION)})"
    # With a lambda in the projection Spark compiles it as many small methods; as one large method the JVM would only interpret it.
    head = f"CASE WHEN exists(array(c), x -> {compiled(f'm[x, {starts(PROC + chr(124) + FUNC)}]')}) THEN 1 ELSE 0 END" if spark else flag("c", starts(PROC + "|" + FUNC))
    sql = rf"""SELECT *, max(CASE WHEN except_before = 1 THEN says_error ELSE 0 END) OVER (PARTITION BY file_path, try_depth, try_id) AS handled FROM (
      SELECT *, max(elsif) OVER (chain) AS if_elsif, max(other) OVER (chain) AS if_else, coalesce(max(other) OVER (PARTITION BY file_path, if_depth, if_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS else_before,
        count(*) OVER (PARTITION BY file_path, if_depth, if_id, asked ORDER BY line) - 1 AS asked_before, max(breaks) OVER (PARTITION BY file_path, loop_depth, loop_id) AS loop_break,
        coalesce(max(excepts) OVER (PARTITION BY file_path, try_depth, try_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS except_before FROM (
      SELECT *, {numbers}{"" if spark else ", " + begun} FROM ({f"SELECT *, {begun} FROM (" if spark else ""}
      SELECT file_path, line, text, inside, body, masked, code, note, bare, c, t, m0, lhs, rhs, first_lhs, first_rhs, head, elsif, other, breaks, excepts, says_error, asked,
        coalesce({last("CASE WHEN c <> '' THEN c END")} OVER (prior), '') AS p1, {n1}{fresh}{unclosed}coalesce(lag(t) OVER (w), '-') AS t1, coalesce(lag(t, 2) OVER (w), '-') AS t2,
        CASE WHEN head = 1 OR {last("CASE WHEN head = 1 THEN 1 WHEN tail = 1 THEN 0 END")} OVER (prior) = 1 THEN sum(head) OVER (w) ELSE 0 END AS scope,
        coalesce({last(f"CASE WHEN {m('c', API_REGION)} THEN 1 WHEN {m('c', starts(END_REGION + '|' + REGION))} THEN 0 END")} OVER (prior), 0) AS api,
        sum(if_opens + loop_opens) OVER (w) - sum(if_closes + loop_closes) OVER (w) AS depth, sum(loop_opens) OVER (w) - sum(loop_closes) OVER (w) - loop_opens AS loops, {depths}, if_opens, loop_opens, try_opens
        FROM (SELECT *, {first('c', blind + sides)} AS lhs, {first('c', blind + sides, 2)} AS rhs, {first('c', rf'^({ID})\s*=')} AS first_lhs, {first('c', rf'^{ID}\s*=\s*({ID})')} AS first_rhs, {asked} AS asked,
          {head} AS head, {flag('c', starts(END_PROC + '|' + END_FUNC))} AS tail, {flag('c', starts(ELSIF))} AS elsif, {flag('c', starts(ELSE))} AS other,
          {flag('c', starts(BREAK))} AS breaks, {flag('c', starts(EXCEPT))} AS excepts, {flag('code', ERROR_TEXT)} AS says_error, {opens}
          FROM (SELECT *, {f"{folded('c')} AS f_c, {folded('code')} AS f_code FROM (SELECT *, " if spark else ""}{trim('code')} AS c, {trim('text')} AS t, {trim('masked')} AS m0, CASE WHEN {compiled(f"M[code, {MIXED}]", engine, set())} THEN regexp_replace(code, '{ACRONYMS}', ''{every}) ELSE '' END AS bare FROM ({strings_sql(lines, engine)}) b){" bb)" if spark else ""} c) d
        WINDOW w AS (PARTITION BY file_path ORDER BY line), prior AS (PARTITION BY file_path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
          later AS (PARTITION BY file_path ORDER BY line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) e{") e2" if spark else ""}) f
      WINDOW chain AS (PARTITION BY file_path, if_depth, if_id)) g"""
    # A named window with a frame stands bare in DuckDB; Spark wants brackets before an operator.
    return sql if engine == "spark" else re.sub(r"OVER \((w|prior|later|chain)\)", r"OVER \1", sql)


def line_facts(lines: DataFrame) -> DataFrame:
    """What line conditions see of each line (file_path, line, text); see ``facts_sql``."""
    return lines.sparkSession.sql(facts_sql("{lines}", "spark").replace("{lines}", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{lines}"), lines=lines)


#: Columns that have a folded one while rules are evaluated, and facts of a block that one line does not tell.
FOLDED = {"c", "code", "n1", "p1", "text", "note", "body"}
CHAIN_FACTS = re.compile(r"\b(?:if_elsif|if_else|else_before|asked_before|loop_break|except_before|handled)\b")
CHAIN_KEYS = ("if_depth", "loop_depth", "try_depth", "if_opens", "loop_opens", "try_opens", "elsif", "other", "breaks", "excepts", "says_error", "asked")
#: Lines that tell something of their block. A line without condition counts like any such line before an ElsIf; the first of a block's is one behind
#: a line that opens, closes or asks, or the first of the file.
BLOCK_LINES = "if_opens = 1 OR loop_opens = 1 OR try_opens = 1 OR elsif = 1 OR other = 1 OR breaks = 1 OR excepts = 1 OR says_error = 1 OR asked <> '' OR fresh = 1"


def _codes(rules: Iterable[tuple[str, str, str, bool, str]], chosen: set[str] | None, folds: set[str] | None = None):
    return [(r[0], r[2], compiled(r[4], folds=folds)) for r in rules if chosen is None or r[0] in chosen]


def _hits(codes, before: str = "") -> str:
    """Spark SQL for the codes whose condition holds, each with its severity's letter, with blanks between; ``before``: hits that stand first.

    The lambda, which adds nothing, keeps the projection from becoming one large method, which the JVM would only
    interpret; the conditions stand outside of it, so they are compiled.
    """
    cases = "".join(f"CASE WHEN {c} THEN '{code}{severity}' END, " for code, severity, c in codes)
    first = f"nullif({before}, ''), " if before else ""
    return f"concat_ws(' ', {first}{cases}filter(array(file_path), x -> x IS NULL))"


def _told(frame: DataFrame, *keys: str) -> DataFrame:
    """A row with code and severity for each of the ``hits`` of a row."""
    severity = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.right("hit", F.lit(1)))
    each = frame.select(*keys, F.explode(F.split(F.nullif("hits", F.lit("")), " ")).alias("hit"))
    return each.select(*keys, F.left("hit", F.char_length("hit") - 1).alias("code"), severity.alias("severity"))


def _with_folds(frame: DataFrame) -> DataFrame:
    return frame.select("*", *(F.expr(folded(c)).alias(f"f_{c}") for c in sorted(FOLDED & set(frame.columns))))


def _fused(frame: DataFrame, rules, chosen: set[str] | None, *keys: str) -> DataFrame:
    """One pass for all rules: the codes whose condition holds, exploded."""
    return _told(frame.select(*keys, F.expr(_hits(_codes(rules, chosen))).alias("hits")), *keys)


def _split(chosen: set[str] | None):
    """Line rules that a line's facts decide, and others as (code, severity's letter, what the line tells, what its block tells)."""
    wanted = [r for r in LINE_RULES if chosen is None or r[0] in chosen]
    plain, own = [r for r in wanted if not CHAIN_FACTS.search(r[4])], []
    for r in (r for r in wanted if CHAIN_FACTS.search(r[4])):
        parts = r[4].split(" AND ")
        own.append((r[0], r[2], " AND ".join(p for p in parts if not CHAIN_FACTS.search(p)), " AND ".join(p for p in parts if CHAIN_FACTS.search(p))))
    return plain, own


def _marked(facts: DataFrame, chosen: set[str] | None, *more: Column | str) -> DataFrame:
    """file_path, line, ``more``, hits of the rules that a line decides, and what block rules need: no text but in ``more``."""
    plain, own = _split(chosen)
    static = [F.expr(compiled(told, folds=FOLDED)).alias(f"is_{code}") for code, _, told, _ in own]
    keys = (*CHAIN_KEYS, F.expr(f"coalesce({BLOCK_LINES}, false)").alias("of_block")) if own else ()
    return _with_folds(facts).select("file_path", "line", *more, F.expr(_hits(_codes(plain, None, FOLDED))).alias("hits"), *keys, *static)


def _line_hits(marked: DataFrame, chosen: set[str] | None) -> DataFrame:
    """Diagnostics of line rules over ``_marked`` lines; blocks are looked at in narrow rows of those lines that tell of them or ask."""
    _, own = _split(chosen)
    if not own:
        return _told(marked, "file_path", "line")
    asks = F.expr("of_block OR " + " OR ".join(f"coalesce(is_{r[0]}, false)" for r in own))
    thin = marked.where(asks).select("file_path", "line", "hits", *CHAIN_KEYS, *(f"is_{r[0]}" for r in own))
    blocks = thin.sparkSession.sql(chains_sql("{thin}"), thin=thin)
    of_blocks = blocks.select("file_path", "line", F.expr(_hits([(code, severity, f"is_{code} AND {told}") for code, severity, _, told in own], "hits")).alias("hits"))
    return _told(of_blocks.unionByName(marked.where(~asks).select("file_path", "line", "hits")), "file_path", "line")


def chains_sql(lines: str) -> str:
    """What blocks tell of each line (Spark SQL over CHAIN_KEYS); ``facts_sql`` has the same for whole facts."""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    numbers = ", ".join(f"sum({k}_opens) OVER (PARTITION BY file_path, {k}_depth ORDER BY line) AS {k}_id" for k in KINDS)
    return f"""SELECT *, max(CASE WHEN except_before = 1 THEN says_error ELSE 0 END) OVER (PARTITION BY file_path, try_depth, try_id) AS handled FROM (
      SELECT *, max(elsif) OVER chain AS if_elsif, max(other) OVER chain AS if_else, coalesce(max(other) OVER (PARTITION BY file_path, if_depth, if_id ORDER BY line {before}), 0) AS else_before,
        count(*) OVER (PARTITION BY file_path, if_depth, if_id, asked ORDER BY line) - 1 AS asked_before, max(breaks) OVER (PARTITION BY file_path, loop_depth, loop_id) AS loop_break,
        coalesce(max(excepts) OVER (PARTITION BY file_path, try_depth, try_id ORDER BY line {before}), 0) AS except_before
      FROM (SELECT *, {numbers} FROM {lines}) WINDOW chain AS (PARTITION BY file_path, if_depth, if_id))"""


def default_rules() -> set[str]:
    return {r[0] for r in ALL_RULES if r[3]}


def line_diagnostics(facts: DataFrame, chosen: set[str] | None = None) -> DataFrame:
    marked = _marked(facts, chosen)
    return _line_hits(stored(marked) if _split(chosen)[1] else marked, chosen)  # two passes read it


def _sums(of: dict[str, str], prefix: str = "") -> tuple[list[Column], list[Column]]:
    """What each line adds to the aggregates ``of``, as columns named with ``prefix``, and the aggregates over these."""
    line, whole = [], []
    for name, sql in of.items():
        found = re.fullmatch(r"(sum|max|min)\((.*)\)", sql)
        if found and found[2] not in ("line", "depth", "head"):
            line.append(F.expr(compiled(found[2], folds=FOLDED)).alias(prefix + name))
        whole.append(F.expr(f"{found[1]}({prefix + name})" if found and found[2] not in ("line", "depth", "head") else sql).alias(name))
    return line, whole


def _scopes(added: DataFrame, sums: list[Column]) -> DataFrame:
    return added.where("scope > 0").groupBy("file_path", "scope").agg(*sums).withColumn("name", F.regexp_extract("header", "(?iu)" + NAME_OF, 1))


def _files(added: DataFrame, sums: list[Column], chosen: set[str] | None) -> DataFrame:
    return _fused(added.groupBy("file_path").agg(*sums).withColumn("line", F.lit(1)), FILE_RULES, chosen, "file_path", "line")


def scope_facts(facts: DataFrame) -> DataFrame:
    line, whole = _sums(SCOPE_FACTS, "s_")
    return _scopes(_with_folds(facts).select("file_path", "scope", "line", "depth", "head", *line), whole)


def scope_diagnostics(facts: DataFrame, chosen: set[str] | None = None) -> DataFrame:
    return _fused(scope_facts(facts), SCOPE_RULES, chosen, "file_path", "line")


def file_diagnostics(facts: DataFrame, chosen: set[str] | None = None) -> DataFrame:
    line, whole = _sums(FILE_FACTS, "m_")
    return _files(_with_folds(facts).select("file_path", "line", "depth", "head", *line), whole, chosen)


#: Lines that a method header may hold.
OF_HEADER = "scope > 0 AND (head = 1 OR unclosed = 1)"


def headers(facts: DataFrame) -> DataFrame:
    """file_path, scope, line, last_line, code and raw (literals emptied, and whole) of every method header, over as many lines as it has."""
    net = F.char_length(F.replace("code", F.lit(")"), F.lit(""))) - F.char_length(F.replace("code", F.lit("("), F.lit("")))
    by = Window.partitionBy("file_path", "scope").orderBy("line")
    inside = facts.where(OF_HEADER).select("file_path", "scope", "line", "c", "code", "head", F.col("body").alias("raw"), F.sum(net).over(by).alias("depth"))
    ended = F.max(((F.col("depth") <= 0) & (F.col("c") != "")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    broken = F.max(((F.col("head") == 0) & F.col("c").rlike("(?iu)" + BEGINS)).cast("int")).over(by)
    part = inside.withColumn("over", F.greatest(F.coalesce(ended, F.lit(0)), broken)).where(F.col("over") == 0)
    told = lambda c: F.array_join(F.transform("parts", lambda p: F.btrim(p[c], F.lit(" \t"))), " ")
    return part.groupBy("file_path", "scope").agg(F.min("line").alias("line"), F.max("line").alias("last_line"), F.sort_array(F.collect_list(F.struct("line", "code", "raw"))).alias("parts")).select(
        "file_path", "scope", "line", "last_line", told("code").alias("code"), told("raw").alias("raw")
    )


def listed_parameters(raw: Column) -> Column:
    """The parameters of a whole header, as they are written."""
    listed = F.regexp_extract_all(F.regexp_extract(raw, r"(?s)^[^(]*\((.*)\)[^)]*$", 1), F.lit(PARAMETER), F.lit(0))
    return F.filter(F.transform(listed, lambda p: F.btrim(p, F.lit(" \t"))), lambda p: p != "")


def parameters(facts: DataFrame) -> DataFrame:
    """file_path, proc, proc_line, ord, name, by_val, default_value (as written) of the parameters of every header."""
    return scoped_parameters(facts).drop("scope")


def scoped_parameters(facts: DataFrame) -> DataFrame:
    """``parameters`` with the scope that each header begins."""
    listed = headers(facts).select("file_path", "scope", F.regexp_extract("code", "(?iu)" + NAME_OF, 1).alias("proc"), F.col("line").alias("proc_line"), F.posexplode(listed_parameters(F.col("raw"))).alias("ord", "p"))
    bare = F.regexp_replace("p", rf"^(?iu)(?:(?:{VAL})\s+)+", "")
    return listed.select("file_path", "scope", "proc", "proc_line", "ord", F.btrim(F.regexp_replace(bare, "(?s)=.*$", "")).alias("name"), F.col("p").rlike(rf"^(?iu)(?:{VAL})\s").alias("by_val"), F.when(F.contains(bare, F.lit("=")), F.btrim(F.regexp_replace(bare, "^[^=]*=", ""))).alias("default_value"))


def parameter_diagnostics(params: DataFrame, chosen: set[str] | None = None) -> DataFrame:
    required, optional = F.when(F.col("default_value").isNull(), F.col("ord")), F.when(F.col("default_value").isNotNull(), F.col("ord"))
    sums = params.groupBy("file_path", F.col("proc_line").alias("line")).agg(
        F.count(F.lit(1)).alias("n_params"), F.count("default_value").alias("n_optional"), F.max(required).alias("last_required"), F.min(optional).alias("first_optional"),
        F.max(F.char_length("name")).alias("longest"), F.max(F.char_length("default_value")).alias("longest_default"),
    )
    return _fused(sums, PARAM_RULES, chosen, "file_path", "line")


def procedures_as_functions(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Assignments from a call of a procedure (BSL117), by the symbols' kinds."""
    word = F.when(F.contains("c", F.lit("=")) & F.contains("c", F.lit("(")), F.lower(F.regexp_extract("c", rf"^{ID}\s*=\s*({ID})\s*\(", 1)))
    called = facts.select("file_path", "line", F.explode(F.filter(F.array(word), lambda w: w != "")).alias("word"))  # a filter behind it would compute the code again
    procedures = symbols.where("kind = 'procedure'").select(F.col("name_lower").alias("word")).distinct()
    return called.join(procedures, "word", "left_semi").select("file_path", "line", F.lit("BSL117").alias("code"), F.lit("ERROR").alias("severity"))


def duplicate_literals(facts: DataFrame, per_scope: int = 3, per_file: int = 4) -> DataFrame:
    """String literals used often in one method (BSL035) or module (BSL132): first line and count."""
    each = facts.where(~F.col("c").rlike("(?iu)" + starts(RAISE))).select("file_path", "scope", "line", F.explode(F.regexp_extract_all("text", F.lit(f"({STRING})"))).alias("literal")).where(F.char_length("literal") > 2)
    scoped = each.groupBy("file_path", "scope", "literal").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    whole = scoped.groupBy("file_path", "literal").agg(F.sum("n").alias("n"), F.min("line").alias("line")).where(F.col("n") >= per_file)
    return scoped.where((F.col("scope") > 0) & (F.col("n") >= per_scope)).select("file_path", "line", F.lit("BSL035").alias("code"), "literal", "n").unionByName(whole.select("file_path", "line", F.lit("BSL132").alias("code"), "literal", "n"))


def query_diagnostics(facts: DataFrame, lines: DataFrame | None = None, chosen: set[str] | None = None) -> DataFrame:
    """Rules over the queries in string literals, at the line where each begins; the facts have the text, so ``lines`` need not be read again."""
    from codeprism.operators.syntax import joined_literals, pieces_of

    lead = F.col("lead") if "lead" in facts.columns else F.when(F.col("inside") == 1, F.concat(F.lit('"'), "text")).otherwise(F.col("text"))
    found = joined_literals(pieces_of(facts.select("file_path", "line", "inside", lead.alias("lead"), "loops"), "loops"), "loops")
    q = found.where(F.col("text").rlike("(?iu)" + QUERY_TEXT)).select("file_path", F.col("start_line").alias("line"), "loops", F.regexp_replace("text", r"\s+", " ").alias("q"))
    fields = F.regexp_extract_all(F.regexp_extract("q", FIELDS, 1), F.lit(PARAMETER), F.lit(0))
    bare = F.filter(fields, lambda f: (F.btrim(f) != "") & ~f.rlike(ALIASED))
    told = q.withColumn("unaliased", F.size(bare)).withColumn("rest", F.regexp_replace("q", UNION_ALL, " "))
    return _fused(told, QUERY_RULES, chosen, "file_path", "line")


def diagnostics(lines: DataFrame, chosen: set[str] | None = None) -> DataFrame:
    """file_path, line, code, severity of the chosen rules (default: those on) over file_path, line, text.

    Every test runs once for each line; what is kept for the rules over methods, modules, headers and
    queries are its outcomes, with text only where a header may stand or a literal does.
    """
    chosen = default_rules() if chosen is None else chosen
    scope, scopes = _sums(SCOPE_FACTS, "s_")
    module, modules = _sums(FILE_FACTS, "m_")
    text = F.when(F.col("inside") == 1, F.concat(F.lit('"'), "text")).otherwise(F.col("text"))
    own = ["unclosed"] + [F.when(F.expr(OF_HEADER), F.col(c)).alias(c) for c in ("code", "body")] + [F.when(F.contains(text, F.lit('"')), text).alias("lead")]
    kept = stored(_marked(line_facts(lines), chosen, "scope", "head", "depth", "loops", "inside", *own, *scope, *module))  # six passes below read columns of it
    out = _line_hits(kept, chosen)
    if any(r[0] in chosen for r in SCOPE_RULES):
        out = out.unionByName(_fused(_scopes(kept, scopes), SCOPE_RULES, chosen, "file_path", "line"))
    if any(r[0] in chosen for r in FILE_RULES):
        out = out.unionByName(_files(kept, modules, chosen))
    if any(r[0] in chosen for r in QUERY_RULES):
        out = out.unionByName(query_diagnostics(kept, chosen=chosen))
    if any(r[0] in chosen for r in PARAM_RULES):
        out = out.unionByName(parameter_diagnostics(parameters(kept.withColumn("c", F.btrim("code", F.lit(" \t")))), chosen))
    return out
